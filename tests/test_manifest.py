import copy

import pytest

from volseg.operators import manifest as M
from volseg.operators.nucleus import mint_id


def example():
    e = {n: str(mint_id(n)) for n in (1, 2, 3)}
    repairs = [{"parent_id": "50", "box": [0, 0, 0, 4, 4, 4], "territories": [{"anchor_id": "1", "emitted_id": e[1]}, {"anchor_id": "2", "emitted_id": e[2]}]}]
    return M.build(repairs, {"7": {"3": e[3]}, "6": {"3": e[3]}, "50": {"1": e[1], "2": e[2]}}, {"watershed": "abc"})


def test_ledger():
    m = M.validate(example(), {"watershed": "abc"})
    assert [r["source"] for r in m["ledger"]["retired"]] == ["6", "7", "50"]
    assert m["ledger"]["consolidated"] == [{"nucleus": "3", "emitted": str(mint_id(3)), "sources": ["6", "7"]}]
    assert len(m["ledger"]["minted"]) == 3


def change(path, value):
    m = copy.deepcopy(example())
    at = m
    for p in path[:-1]:
        at = at[p]
    at[path[-1]] = value
    if path[0] in ("repairs", "owners"):
        m["plan_digest"] = M.digest({k: m[k] for k in ("repairs", "owners", "inputs")})
    return m


@pytest.mark.parametrize("path,value", [
    (("version",), "2.0"), (("complete",), False), (("plan_digest",), "x"), (("repairs", 0, "territories"), []), (("repairs", 0, "territories", 0, "emitted_id"), "50"),
    (("owners", "7", "3"), "12"), (("owners", "7", "3"), "012"), (("ledger", "minted"), []), (("repairs", 0, "territories", 1, "anchor_id"), "1"),
])
def test_refused(path, value):
    with pytest.raises(ValueError):
        M.validate(change(path, value))


def test_other_inputs():
    with pytest.raises(ValueError):
        M.validate(example(), {"watershed": "other"})


def test_migration():
    new = example()
    old = {"version": "1.2", "owners": new["owners"], "repairs": [{
        "parent_id": 50, "box": [0, 0, 0, 4, 4, 4], "marker_nucleus_ids": {"1": 1, "2": 2}, "marker_labels": {str(i): mint_id(i) for i in (1, 2)},
    }]}
    got = M.migrate(old, {"50": {1, 2}}, {"watershed": "abc"})
    assert got["ledger"] == new["ledger"] and got["plan_digest"] == new["plan_digest"] and got["migrated_from"]["version"] == "1.2"
    with pytest.raises(ValueError, match="cannot be migrated"):
        M.migrate({**old, "version": "1.0"}, {"50": {1, 2}}, {})
    with pytest.raises(ValueError, match="not those"):
        M.migrate(old, {"50": {1, 2, 3}}, {})
    opaque = copy.deepcopy(old)
    opaque["repairs"][0]["marker_labels"]["1"] = 77
    with pytest.raises(ValueError, match="not the id"):
        M.migrate(opaque, {"50": {1, 2}}, {})
