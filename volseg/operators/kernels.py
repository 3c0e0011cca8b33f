"""Sequential kernels that run inside one component, block or unit. Plain Python, no Spark."""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

from volseg.config import Agglomeration
from volseg.schema import CONFLICT, NONE, PROPER


class Sets:
    """Disjoint sets over any ids; a link names the id that stands for both."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (nxt := self.up.get(root, root)) != root:
            root = nxt
        while (nxt := self.up.get(x, x)) != root:
            self.up[x] = root
            x = nxt
        return root

    def link(self, keep: int, gone: int) -> None:
        self.up[gone] = keep


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of the edges and the least id of each one's component."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        x, y = up[u], up[v]
        apart = x != y
        if not apart.any():
            return ids, ids[up]
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(nxt := up[up], up):
            up = nxt


def join_nuclei(a: tuple, b: tuple) -> tuple:
    """Two records (state, id, count, total) as one."""
    total = a[3] + b[3]
    if CONFLICT in (a[0], b[0]):
        return CONFLICT, 0, 0, total
    if NONE in (a[0], b[0]):
        keep = a if a[0] != NONE else b
        return keep[0], keep[1], keep[2], total
    return (PROPER, a[1], a[2] + b[2], total) if a[1] == b[1] else (CONFLICT, 0, 0, total)


def nuclei_agree(a: tuple, b: tuple) -> bool:
    return NONE in (a[0], b[0]) or (a[0] == b[0] == PROPER and a[1] == b[1])


@dataclass
class Node:
    """What agglomeration knows of a segment."""

    supervoxels: int = 1
    size: int = 0
    frozen: bool = False
    labels: tuple[int, int, int] = (0, 0, 0)
    nucleus: tuple = (NONE, 0, 0, 0)
    edges: dict[int, list] = field(default_factory=dict)


def confident_label(labels: tuple[int, int, int], p: Agglomeration) -> int | None:
    """The dominant label of enough voxels with enough of a share, the first at ties."""
    total = sum(labels)
    top = max(labels)
    return labels.index(top) if total >= p.labelled and top >= p.dominance * total else None


def agglomerate(edges: Iterable[tuple[int, int, float, int]], nodes: dict[int, Node], p: Agglomeration, by_degree: bool = True, stop: float | None = None) -> dict[str, list]:
    """Merge along the edge of greatest mean affinity while it exceeds the target.

    Ties go to the smaller pair of ids. Returns ``remap`` (old, new), in order of the merges, and the edges that
    were set aside as (s1, s2, sum, area): ``residual`` next to frozen segments, ``nucleus``, ``semantic`` and
    ``size`` vetoes, ``twig`` merges, and ``final``, what is left below the target. An edge that was vetoed does
    not come back, nor does one that the twig rule refuses. ``nodes`` is left with what the segments have become.

    With ``stop`` above the target the run ends there and what is left is ``open``, to go on from with ``nodes``:
    a mean never exceeds the greater of the means it is made of, so no edge rises above ``stop`` again.
    """
    out: dict[str, list] = {k: [] for k in ("remap", "residual", "nucleus", "semantic", "size", "twig", "final", "open")}
    limit = p.target if stop is None else stop
    heap = []

    def push(a: int, b: int, w: list) -> None:
        lo, hi = (a, b) if a < b else (b, a)
        heapq.heappush(heap, (-w[0] / w[1] if w[1] else 0.0, lo, hi, w[2]))

    version = 0
    for a, b, total, area in edges:
        if a == b:
            continue
        na, nb = nodes.setdefault(a, Node()), nodes.setdefault(b, Node())
        w = na.edges.get(b)
        if w is None:
            na.edges[b] = nb.edges[a] = [total, area, 0]
        else:
            w[0] += total
            w[1] += area
    for a, node in nodes.items():
        for b, w in node.edges.items():
            if a < b:
                push(a, b, w)

    def drop(a: int, b: int, kind: str | None) -> None:
        w = nodes[a].edges.pop(b)
        del nodes[b].edges[a]
        if kind:
            out[kind].append((min(a, b), max(a, b), w[0], w[1]))

    while heap:
        key, a, b, seen = heapq.heappop(heap)
        w = nodes[a].edges.get(b) if a in nodes else None
        if w is None or w[2] != seen:
            continue
        mean = -key
        if not mean > limit:
            break
        u, v = nodes[a], nodes[b]
        if u.frozen or v.frozen:
            u.frozen = v.frozen = True
            drop(a, b, "residual")
            continue
        if not nuclei_agree(u.nucleus, v.nucleus):
            drop(a, b, "nucleus")
            continue
        if mean <= p.semantic:
            la, lb = confident_label(u.labels, p), confident_label(v.labels, p)
            if la is not None and lb is not None and la != lb:
                drop(a, b, "semantic")
                continue
        if mean <= p.size_affinity and min(u.size, v.size) > p.small and u.size + v.size > p.large:
            drop(a, b, "size")
            continue
        if p.twig > 0 and mean <= p.threshold:
            if min(u.size, v.size) > p.twig_size or w[1] > p.twig_area:
                drop(a, b, None)
                continue
            out["twig"].append((a, b, w[0], w[1]))
        keep, gone = a, b
        weight = (len(u.edges), len(v.edges)) if by_degree else (u.supervoxels, v.supervoxels)
        if weight[1] > weight[0]:
            keep, gone = b, a
        tagged = [k for k in (a, b) if nodes[k].nucleus[0] != NONE]
        if len(tagged) == 1:
            keep, gone = tagged[0], a + b - tagged[0]
        r, g = nodes[keep], nodes[gone]
        out["remap"].append((gone, keep))
        r.supervoxels += g.supervoxels
        r.size += g.size
        r.labels = tuple(x + y for x, y in zip(r.labels, g.labels))
        r.nucleus = join_nuclei(r.nucleus, g.nucleus)
        drop(a, b, None)
        for c, e in list(g.edges.items()):
            other = nodes[c]
            del other.edges[gone]
            version += 1
            have = r.edges.get(c)
            if have is None:
                e[2] = version
                r.edges[c] = other.edges[keep] = e
                push(keep, c, e)
            else:
                have[0] += e[0]
                have[1] += e[1]
                have[2] = version
                push(keep, c, have)
        del nodes[gone]
    for a, node in nodes.items():
        for b, w in node.edges.items():
            if a < b:
                kind = "open" if stop is not None else "residual" if node.frozen and nodes[b].frozen else "final"
                out[kind].append((a, b, w[0], w[1]))
    return out


def join_small(edges: Iterable[tuple[float, int, int]], nodes: dict[int, list], limit: int) -> dict[int, int]:
    """Basins joined along edges (score, a, b), in the order given, while one of a pair is small.

    ``nodes``: basin to [size, at the border, ...], left with what the basins have become. Two basins of at least
    ``limit`` voxels stay apart. Interior ones join; a small interior one joins a large one at the border. Other
    pairs stay apart, and both then count as border. Returns what stands for each basin that was joined.
    """
    sets = Sets()
    for _, a, b in edges:
        x, y = sorted((sets.find(a), sets.find(b)))
        if x == y or not x:
            continue
        u, v = nodes[x], nodes[y]
        big = u[0] >= limit, v[0] >= limit
        if all(big):
            continue
        if not (u[1] or v[1]) or (big[0] and not v[1]) or (big[1] and not u[1]):
            u[0] += v[0]
            u[1] = u[1] or v[1]
            sets.link(x, y)
        else:
            u[1] = v[1] = True
    return {i: sets.find(i) for i in list(sets.up)}


def join_descents(edges: Iterable[tuple[float, int, int]], nodes: dict[int, list], top: float) -> dict[int, int]:
    """Basins cut at a seam joined along edges (score, a, b), in the order given, where the edge is the steepest
    descent of either side.

    ``nodes``: basin to [size, at the border, descent]. The greater descent of the two holds for both, but only if
    it is that of the edge; otherwise they drain elsewhere and ``top`` takes its place.
    """
    sets = Sets()
    for score, a, b in edges:
        x, y = sorted((sets.find(a), sets.find(b)))
        if x == y:
            continue
        u, v = nodes[x], nodes[y]
        if score in (u[2], v[2]):
            high = max(u[2], v[2])
            u[:] = [u[0] + v[0], u[1] or v[1], high if high == score else top]
            sets.link(x, y)
    return {i: sets.find(i) for i in list(sets.up)}


def merge_small(edges: list[tuple[float, int, int]], size: dict[int, int], border: dict[int, bool], limit: int, dust: int, above: float) -> tuple[dict[int, int], list[tuple[float, int, int]], dict[int, tuple[int, bool]]]:
    """:func:`join_small` along falling scores above ``above``, for all edges at once.

    What is smaller than ``dust`` and interior goes to 0. Returns old to new (the least member id, or 0), the maximum
    spanning forest of the edges above the threshold between what is left, and the new (size, border) records.
    """
    order = sorted((e for e in edges if e[0] > above), key=lambda e: (-e[0], e[1], e[2]))
    nodes = {s: [size[s], border[s]] for s in size}
    stand = join_small(order, nodes, limit)
    new = {}
    for s in size:
        r = stand.get(s, s)
        new[s] = r if r and (nodes[r][1] or nodes[r][0] >= dust) else 0
    kept = [(w, *sorted((new.get(x, 0), new.get(y, 0)))) for w, x, y in order]
    return new, spanning_forest([e for e in kept if e[1] and e[1] != e[2]]), {r: tuple(nodes[r]) for r in set(new.values()) if r}


def spanning_forest(edges: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """The maximum spanning forest; ties go to the smaller pair of ids."""
    sets, out = Sets(), []
    for w, a, b in sorted(edges, key=lambda e: (-e[0], e[1], e[2])):
        x, y = sets.find(a), sets.find(b)
        if x != y:
            sets.link(min(x, y), max(x, y))
            out.append((w, a, b))
    return out


#: Direction bits: towards the voxel before on x, y, z, then the one after.
BITS = (1, 2, 4, 8, 16, 32)


def basins(bits: np.ndarray, halo: bool = False) -> np.ndarray:
    """Basin of each voxel of a block ``bits[x, y, z]`` of direction bits, numbered from 1; 0 without any direction.

    With ``halo`` the outermost voxels lie beyond the block: none starts a basin, but trails lead into them and, where
    their bits point back, out again; what drains into the same one is one basin. Their labels are not returned.
    Voxels are taken in the order z, y, x (x fastest). From each that has no basin yet the directions are followed
    breadth first. The trail joins the first basin it meets, and founds a new one if it meets none. A step that the
    voxel reached does not return is a descent off the plateau: the search goes on from there alone.
    """
    shape = bits.shape
    flat = bits.transpose(2, 1, 0).ravel()
    step = [-1, -shape[0], -shape[0] * shape[1], 1, shape[0], shape[0] * shape[1]]
    moves = [[(step[d], BITS[(d + 3) % 6]) for d in range(6) if b & BITS[d]] for b in range(64)]
    own = np.ones(shape[::-1], dtype=bool)
    if halo:
        own[:] = False
        own[1:-1, 1:-1, 1:-1] = True
    basin = np.full(flat.size, -1, dtype=np.int64)
    basin[(flat == 0) & own.ravel()] = 0
    codes, seen, count = flat.tolist(), bytearray(flat.size), 0
    label = basin.tolist()
    for start in np.flatnonzero(own).tolist():
        if label[start] >= 0:
            continue
        trail, queue, found = [start], [start], None
        seen[start] = 1
        while queue and found is None:
            following = []
            for at in queue:
                for by, back in moves[codes[at]]:
                    to = at + by
                    if label[to] >= 0:
                        found = label[to]
                        break
                    if not seen[to]:
                        seen[to] = 1
                        trail.append(to)
                        if not codes[to] & back:
                            following = [to]
                            break
                        following.append(to)
                else:
                    continue
                break
            queue = following
        if found is None:
            count += 1
            found = count
        for at in trail:
            label[at] = found
    out = np.array(label, dtype=np.int64).reshape(shape[::-1]).transpose(2, 1, 0)
    return out[1:-1, 1:-1, 1:-1] if halo else out


def flood(cost: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeded watershed over six neighbours: the cheapest voxel next, the oldest at equal cost."""
    out = np.where(mask, seeds, 0).astype(np.int64)
    heap: list[tuple] = []
    age = 0
    for at in zip(*np.nonzero(out)):
        heap.append((float(cost[at]), age, at))
        age += 1
    heapq.heapify(heap)
    shape = out.shape
    while heap:
        _, _, at = heapq.heappop(heap)
        for axis in range(3):
            for by in (-1, 1):
                to = list(at)
                to[axis] += by
                if 0 <= to[axis] < shape[axis]:
                    to = tuple(to)
                    if mask[to] and not out[to]:
                        out[to] = out[at]
                        heapq.heappush(heap, (float(cost[to]), age, to))
                        age += 1
    return out


def match(rows: list[tuple[int, int, int, int]], nuclei: dict[int, tuple]) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Rows (oid, boundary size, nid, agg size) joined, the largest agglomerate first, unless nuclei forbid it.

    Returns old to new, the representative being the first accepted nid of each group, and the pairs cut.
    """
    sets, records, cuts, first = Sets(), dict(nuclei), [], []
    none = (NONE, 0, 0, 0)
    for oid, _, nid, _ in sorted(rows, key=lambda r: (-r[3], r[2], r[0])):
        a, b = sets.find(oid), sets.find(nid)
        if a != b:
            ra, rb = records.get(a, none), records.get(b, none)
            if not nuclei_agree(ra, rb):
                cuts.append((oid, nid))
                continue
            sets.link(b, a)
            records[b] = join_nuclei(ra, rb)
        first.append(nid)
    stand: dict[int, int] = {}
    for nid in first:
        stand.setdefault(sets.find(nid), nid)
    ids = {x for r in rows for x in (r[0], r[2])}
    return {i: stand.get(sets.find(i), sets.find(i)) for i in ids}, cuts


#: Half of the 26 neighbours; the others look back.
_AHEAD = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]


def touching_groups(coords: np.ndarray, group: np.ndarray) -> np.ndarray:
    """For each distinct coordinate ``coords[n, 3]`` of a group a row of the connected part (26 neighbours) it is in.

    Groups are numbered 0, 1, ...; they are laid out side by side, two voxels apart, and taken all at once.
    """
    if not len(coords):
        return np.array([], dtype=np.int64)
    n = int(group.max()) + 1
    low = np.full((n, 3), np.iinfo(np.int64).max)
    np.minimum.at(low, group, coords)
    at = coords - low[group]
    width = np.zeros(n, dtype=np.int64)
    np.maximum.at(width, group, at[:, 0] + 2)
    at[:, 0] += (np.cumsum(width) - width)[group]
    size = at.max(axis=0) + 2
    code = (at[:, 0] * size[1] + at[:, 1]) * size[2] + at[:, 2]
    order = np.argsort(code)
    ranked = code[order]
    pairs = []
    for step in _AHEAD:
        near = at + step
        fits = (near[:, 1:] >= 0).all(axis=1)
        want = (near[:, 0] * size[1] + near[:, 1]) * size[2] + near[:, 2]
        found = np.minimum(np.searchsorted(ranked, want), len(ranked) - 1)
        hit = np.flatnonzero(fits & (ranked[found] == want))
        pairs.append((hit, order[found[hit]]))
    a, b = (np.concatenate(x) for x in zip(*pairs))
    own = np.arange(len(coords))
    ids, root = stars(np.concatenate([a, own]), np.concatenate([b, own]))
    return root


def coordinate_components(coords: list[tuple[int, int, int]]) -> list[int]:
    """Component number of each coordinate, joined over 26 neighbours; numbered by first appearance."""
    if not coords:
        return []
    root = touching_groups(np.array(coords, dtype=np.int64), np.zeros(len(coords), dtype=np.int64))
    # a root is the first row of its part
    number = {int(r): k for k, r in enumerate(np.unique(root))}
    return [number[int(r)] for r in root]


def reweighted_mean(contact: dict[tuple[int, int, int], tuple[float, int, float]], trim: float = 0.25, least: int = 20) -> tuple[float, int]:
    """Affinity and area of a contact, its strong cores weighing more.

    ``contact``: coordinate to (affinity sum, number of edges, greatest affinity). Each patch, a connected part of
    the contact, is trimmed to the coordinates with an affinity above ``trim``; a core with affinity S > 1 adds (S - 1) times its
    affinity and area. Of the whole contact and its patches of more than ``least`` edges the greatest mean counts.
    """

    def parts(coords: list) -> list[list]:
        label = coordinate_components(coords)
        return [[c for c, k in zip(coords, label) if k == g] for g in range(max(label, default=-1) + 1)]

    def total(coords: list) -> tuple[float, int]:
        return sum(contact[c][0] for c in coords), sum(contact[c][1] for c in coords)

    whole = sorted(contact)
    affinity, area = total(whole)
    weight, found = float(area), []
    for patch in parts(whole):
        a, n = total(patch)
        wa, wn = 0.0, float(n)
        for core in parts([c for c in patch if contact[c][2] > trim]):
            ca, cn = total(core)
            if ca > 1:
                wa += (ca - 1) * ca
                wn += (ca - 1) * cn
        affinity += wa
        weight += wn - n
        if n > least:
            found.append(((a + wa) * n / wn, n))
    found.append((affinity * area / weight, area))
    return max(found, key=lambda r: r[0] / r[1])


def _grown(mask: np.ndarray, steps: list[tuple[int, int, int]], full: bool) -> np.ndarray:
    """The mask widened by the steps (``full`` False) or narrowed to where all of them stay within it (True)."""
    r = max((abs(d) for s in steps for d in s), default=0)
    wide = np.pad(mask, r, constant_values=full)
    parts = [wide[tuple(slice(r + d, r + d + n) for d, n in zip(s, mask.shape))] for s in steps]
    return np.logical_and.reduce(parts) if full else np.logical_or.reduce(parts)


def closed(mask: np.ndarray, steps: list[tuple[int, int, int]]) -> np.ndarray:
    """Binary closing by a set of steps that holds the opposite of each; beyond the array there is nothing to close."""
    r = max((abs(d) for s in steps for d in s), default=0)
    wide = np.pad(mask, r)
    out = _grown(_grown(wide, steps, False), steps, True)
    return out[tuple(slice(r, r + n) for n in mask.shape)]


def element(shape: str, r: int) -> list[tuple[int, int, int]]:
    """Structuring elements of radius r: lines along ``x``, ``y``, ``z``, the diagonals ``d`` and ``a`` of the plane x, y,
    and the ``diamond`` in it."""
    line = range(-r, r + 1)
    if shape == "diamond":
        return [(i, j, 0) for i in line for j in line if abs(i) + abs(j) <= r]
    along = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1), "d": (1, 1, 0), "a": (1, -1, 0)}[shape]
    return [tuple(i * d for d in along) for i in line]


def close_affinities(affinities: np.ndarray, radii: tuple[int, int, int], factors: tuple[float, float, float], threshold: float) -> np.ndarray:
    """Gaps between weak edges (0 < a < threshold) of ``affinities[3, x, y, z]`` lessened channel by channel, by falling radius.

    On z a gap is what closing along z fills. On x and y it is what the diamond fills, and beyond radius 1 not both
    the lines along x and y or both diagonals. The weak edges are those before any change to the channel.
    """
    out = affinities.copy()
    for i in range(3):
        weak = (out[i] > 0) & (out[i] < threshold)
        for r in range(radii[i], 0, -1):
            if i == 2:
                gap = closed(weak, element("z", r)) & ~weak
            else:
                gap = closed(weak, element("diamond", r))
                if r > 1:
                    small = (closed(weak, element("x", r)) & closed(weak, element("y", r))) | (closed(weak, element("d", r)) & closed(weak, element("a", r)))
                    gap &= ~small
            out[i] = np.where(gap, out[i] * factors[i], out[i])
    return out
