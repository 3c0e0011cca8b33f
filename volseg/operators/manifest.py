"""The manifest of a nucleus competition: what was retired, what was emitted, and proof of its inputs. Driver side.

A manifest lists the few segments that were shared out, not the volume. Ids are decimal strings.
"""

from __future__ import annotations

import hashlib
import json
import re

from volseg.operators.nucleus import mint_id

VERSION = "3.0"
DECIMAL = re.compile(r"[1-9][0-9]*\Z")


def decimal_id(text: str) -> int:
    """A positive id in canonical decimal form; leading zeros and other spellings are errors."""
    if not isinstance(text, str) or not DECIMAL.match(text):
        raise ValueError(f"{text!r} is no decimal id")
    return int(text)


def canonical_json(value: object) -> bytes:
    """The bytes that digests are taken of: sorted keys, two spaces, a final line break."""
    return (json.dumps(value, indent=2, sort_keys=True) + "\n").encode()


def digest(value: object) -> str:
    return hashlib.sha256(value if isinstance(value, bytes) else canonical_json(value)).hexdigest()


def ledger(repairs: list[dict], owners: dict[str, dict[str, str]]) -> dict:
    """Retirements, consolidations and minted ids.

    ``owners``: segment to its qualifying nuclei and their emitted ids; a segment with exactly one is renamed, and
    segments renamed to the same id are a consolidation. ``repairs``: segments shared out, with ``parent_id``,
    ``box`` and ``territories`` of ``anchor_id`` and ``emitted_id``; what lies outside the territories stays.
    """
    renamed = {s: next(iter(o.items())) for s, o in owners.items() if len(o) == 1}
    sources: dict[tuple[int, int], list[int]] = {}
    retired = []
    for s in sorted(renamed, key=decimal_id):
        nucleus, emitted = renamed[s]
        retired.append({"source": s, "why": "single owner", "emitted": [emitted]})
        sources.setdefault((decimal_id(nucleus), decimal_id(emitted)), []).append(decimal_id(s))
    for r in repairs:
        retired.append({"source": r["parent_id"], "why": "shared out", "box": r["box"], "emitted": sorted({t["emitted_id"] for t in r["territories"]}, key=decimal_id)})
    minted = {e for o in owners.values() for e in o.values()} | {t["emitted_id"] for r in repairs for t in r["territories"]}
    return {
        "retired": retired,
        "consolidated": [{"nucleus": str(n), "emitted": str(e), "sources": [str(x) for x in sorted(v)]} for (n, e), v in sorted(sources.items())],
        "minted": sorted(minted, key=decimal_id),
    }


def build(repairs: list[dict], owners: dict[str, dict[str, str]], inputs: dict[str, str]) -> dict:
    """A complete manifest; ``inputs`` are the digests of what the competition read."""
    plan = {"repairs": repairs, "owners": owners, "inputs": inputs}
    return {"version": VERSION, "complete": True, "plan_digest": digest(plan), **plan, "ledger": ledger(repairs, owners)}


def validate(manifest: dict, inputs: dict[str, str] | None = None) -> dict:
    """The manifest if it is complete, of this version, unchanged, and if every emitted id is its nucleus's own."""
    if manifest.get("version") != VERSION:
        raise ValueError(f"manifest version {manifest.get('version')!r} is not {VERSION}")
    if manifest.get("complete") is not True:
        raise ValueError("the manifest is not complete")
    plan = {k: manifest[k] for k in ("repairs", "owners", "inputs")}
    if digest(plan) != manifest.get("plan_digest"):
        raise ValueError("the manifest's digest does not fit its content")
    if inputs is not None and inputs != manifest["inputs"]:
        raise ValueError("the manifest was made from other inputs")
    pairs = [(n, e) for o in plan["owners"].values() for n, e in o.items()]
    for r in plan["repairs"]:
        if not r["territories"]:
            raise ValueError("a repair without territories")
        anchors = [t["anchor_id"] for t in r["territories"]]
        if len(set(anchors)) != len(anchors):
            raise ValueError("an anchor occurs twice in a repair")
        if any(t["emitted_id"] == r["parent_id"] for t in r["territories"]):
            raise ValueError("a retired segment cannot be emitted")
        pairs += [(t["anchor_id"], t["emitted_id"]) for t in r["territories"]]
    for nucleus, emitted in pairs:
        if decimal_id(emitted) != mint_id(decimal_id(nucleus)):
            raise ValueError(f"{emitted} is not the id of nucleus {nucleus}")
    if manifest.get("ledger") != ledger(plan["repairs"], plan["owners"]):
        raise ValueError("the ledger does not fit the repairs")
    return manifest


def migrate(legacy: dict, markers: dict[str, set[int]], inputs: dict[str, str]) -> dict:
    """A manifest of version 1.2 as one of this version, without flooding again.

    In 1.2 a repair names its territories by markers 1, 2, ...: ``marker_nucleus_ids`` and ``marker_labels`` give
    each one's nucleus and emitted id. ``markers``: for each parent id the markers found in its stored territory,
    which must be just those named. Ids must be the nuclei's own, so manifests of other versions, whose ids are
    opaque, are refused.
    """
    if str(legacy.get("version")) != "1.2":
        raise ValueError(f"manifests of version {legacy.get('version')!r} cannot be migrated")
    repairs = []
    for r in legacy["repairs"]:
        parent, nuclei, labels = str(r["parent_id"]), r.get("marker_nucleus_ids"), r.get("marker_labels")
        if not isinstance(nuclei, dict) or not isinstance(labels, dict):
            raise ValueError(f"the repair of {parent} names no markers")
        found = markers.get(parent, set())
        if {int(k) for k in nuclei} != found or {int(k) for k in labels} != found:
            raise ValueError(f"the markers of {parent} are not those of its territory")
        territories = [{"anchor_id": str(nuclei[str(m)]), "emitted_id": str(labels[str(m)])} for m in sorted(found)]
        repairs.append({"parent_id": parent, "box": r["box"], "territories": territories})
    out = build(repairs, legacy.get("owners", {}), inputs)
    return validate({**out, "migrated_from": {"version": "1.2", "digest": digest(legacy)}})
