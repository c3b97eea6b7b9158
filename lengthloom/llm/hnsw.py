"""Hierarchical navigable small-world graphs over unit vectors, built and searched for many rows at once with NumPy.

Rows stand in falling order of their level, so those of layer l are the first ``len(layers[l])`` and all layers share positions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Links of a new row; links of a row that is pruned at the bottom layer (half above it), and places beyond them before it is.
M, BOTTOM, SLACK = 16, 32, 8
#: Beam of the construction, and rows that are inserted at once at most.
BUILD_BEAM, PORTION = 64, 512
#: Rows that search at once.
ROWS = 512


@dataclass
class Graph:
    x: np.ndarray  # rows x d, float32, unit length
    layers: list[np.ndarray]  # links by position, -1 where there is none; the first is the bottom one


def levels(n: int) -> np.ndarray:
    """Falling levels of n rows: a row reaches level l with probability M^-l; one row at least is in each layer."""
    u = np.random.default_rng(n).random(n)
    return np.sort((-np.log1p(-u) / np.log(M)).astype(np.int64))[::-1]


def _score(q: np.ndarray, x: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", q[rows], x[cols])


def beam(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best rows that each query finds in a layer: (positions, scores), in no order, -1 and -inf where fewer.

    entry: distinct positions to start from, -1 for none. All queries take a step at once: each opens the best row of its
    beam that isn't open and meets its links; a query ends when all of its beam is open.
    """
    n, m = len(q), len(links)
    seen = np.zeros((n, m + 1), bool)
    seen[:, m] = True  # where -1 points
    found, score, shut = np.full((n, width), -1, np.int64), np.full((n, width), -np.inf, np.float32), np.zeros((n, width), bool)

    def meet(live: np.ndarray, near: np.ndarray) -> None:
        """Take rows of ``near``, new to their query, into its beam."""
        new = ~seen[live[:, None], near]
        seen[live[:, None], near] = True
        r, c = np.nonzero(new)
        s = np.full(near.shape, -np.inf, np.float32)
        s[r, c] = _score(q, x, live[r], near[r, c])
        some = np.flatnonzero((s > score[live].min(axis=1)[:, None]).any(axis=1))
        at = live[some]
        all_s, all_f = np.hstack([score[at], s[some]]), np.hstack([found[at], near[some]])
        all_o = np.hstack([shut[at], np.zeros((len(some), near.shape[1]), bool)])
        best = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        score[at], found[at], shut[at] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_f, best, 1), np.take_along_axis(all_o, best, 1)

    live = np.arange(n)
    meet(live, entry)
    while len(live):
        open_ = np.where(shut[live], -np.inf, score[live])
        j = open_.argmax(axis=1)
        on = open_[np.arange(len(live)), j] > -np.inf
        live, j = live[on], j[on]
        if len(live):
            shut[live, j] = True
            meet(live, links[found[live, j]])
    found[np.isinf(score)] = -1
    return found, score


def choose(x: np.ndarray, near: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Up to k links among candidates: each is taken, best first, if no taken one is closer to it than the row is; then the
    best of the others fill up. near: -1 for none. Returns positions, -1 where fewer."""
    by = np.argsort(-score, axis=1, kind="stable")
    near, score = np.take_along_axis(near, by, 1), np.take_along_axis(score, by, 1)
    v = x[near]
    between = v @ v.transpose(0, 2, 1)
    taken, nearest = np.zeros(near.shape, bool), np.full(near.shape, -np.inf, np.float32)
    left = np.full(len(near), k)
    for j in range(near.shape[1]):
        ok = (near[:, j] >= 0) & (left > 0) & (score[:, j] >= nearest[:, j])
        taken[ok, j] = True
        left -= ok
        nearest[ok] = np.maximum(nearest[ok], between[ok, j])
    rest = (near >= 0) & ~taken
    taken |= rest & (np.cumsum(rest, axis=1) <= left[:, None])
    first = np.argsort(~taken, axis=1, kind="stable")[:, :k]
    return np.where(np.take_along_axis(taken, first, 1), np.take_along_axis(near, first, 1), -1)


def _link_back(x: np.ndarray, links: np.ndarray, src: np.ndarray, dst: np.ndarray, most: int) -> None:
    """Give dst a link to src; rows without a place are pruned to ``most`` links."""
    s = _score(x, x, src, dst)
    by = np.lexsort((-s, dst))
    src, dst = src[by], dst[by]
    head = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
    place = np.arange(len(dst)) - np.repeat(head, np.diff(np.append(head, len(dst))))
    some = place < most  # a row that so many chose at once: the others have their own links
    src, dst, place = src[some], dst[some], place[some]
    known = (links[dst] == src[:, None]).any(axis=1)
    src, dst = src[~known], dst[~known]
    if not len(dst):
        return
    head = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
    of = np.diff(np.append(head, len(dst)))
    place = np.arange(len(dst)) - np.repeat(head, of)
    rows, used = dst[head], (links[dst[head]] >= 0).sum(axis=1)
    full = used + of > links.shape[1]
    fits = np.repeat(~full, of)
    links[dst[fits], np.repeat(used, of)[fits] + place[fits]] = src[fits]
    for part in np.array_split(np.flatnonzero(full), -(-int(full.sum()) // 1024) or 1):
        if not len(part):
            continue
        wide = np.full((len(part), links.shape[1] + int(of[part].max())), -1)
        wide[:, : links.shape[1]] = links[rows[part]]
        at = np.repeat(np.arange(len(part)), of[part])
        each = np.concatenate([np.arange(head[p], head[p] + of[p]) for p in part])
        wide[at, links.shape[1] + place[each]] = src[each]
        s = np.where(wide >= 0, np.einsum("ij,ikj->ik", x[rows[part]], x[wide]), -np.inf).astype(np.float32)
        links[rows[part]] = -1
        links[rows[part], :most] = choose(x, wide, s, most)


def build(x: np.ndarray) -> Graph:
    """Insert the rows of x, which stand in the order of levels(len(x)), portion by portion: beams through the layers
    above find where each row lies, and the rows of a portion are candidates of each other too."""
    n = len(x)
    level = levels(n)
    sizes = [int(np.searchsorted(-level, -layer, "right")) for layer in range(int(level[0]) + 1)] if n else []
    most = [BOTTOM if layer == 0 else M for layer in range(len(sizes))]
    layers = [np.full((s, m + SLACK), -1, np.int32) for s, m in zip(sizes, most, strict=True)]
    a = 0
    while a < n:
        b = min(n, a + max(M, min(PORTION, a // 2)))
        q, entry = x[a:b], np.zeros((b - a, 1), np.int64)
        for layer in range(len(sizes) - 1, -1, -1):
            inside = max(0, min(b, sizes[layer]) - a)
            if a:
                found, score = beam(q, x, layers[layer][: min(a, sizes[layer])], entry, BUILD_BEAM if inside else 4)
                entry = np.take_along_axis(found, np.argpartition(-score, min(4, score.shape[1]) - 1, axis=1)[:, :4], 1)
            if not inside:
                continue
            peers = x[a : a + inside] @ x[a : a + inside].T
            np.fill_diagonal(peers, -np.inf)
            k = min(M, inside)
            near = np.argpartition(-peers, k - 1, axis=1)[:, :k]
            s = np.take_along_axis(peers, near, 1)
            near = np.where(np.isinf(s), -1, near + a)
            if a:
                near, s = np.hstack([near, found[:inside]]), np.hstack([s, score[:inside]])
            if near.shape[1] > 3 * M:
                best = np.argpartition(-s, 3 * M - 1, axis=1)[:, : 3 * M]
                near, s = np.take_along_axis(near, best, 1), np.take_along_axis(s, best, 1)
            chosen = choose(x, near, s, M)
            layers[layer][a : a + inside, : chosen.shape[1]] = chosen
            src, c = np.nonzero(chosen >= 0)
            _link_back(x, layers[layer], src + a, chosen[src, c], most[layer])
        a = b
    return Graph(x, layers)


def search(g: Graph, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of up to ``width`` rows near each query; -1 and -inf where fewer."""
    found, score = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32)
    for a in range(0, len(q), ROWS):
        some = q[a : a + ROWS]
        entry = np.zeros((len(some), 1), np.int64)
        for layer in range(len(g.layers) - 1, 0, -1):
            entry, _ = beam(some, g.x, g.layers[layer], entry, 8)
        found[a : a + ROWS], score[a : a + ROWS] = beam(some, g.x, g.layers[0], entry, width)
    return found, score


def audited_width(g: Graph, threshold: float, recall: float, rows: int = 512, first: int = 16) -> int:
    """The beam that finds planted neighbours: of up to ``rows`` rows, each moved to a cosine of ``threshold`` with itself, doubled
    until a share of ``recall`` of them is found, or until the beam holds the whole graph."""
    n, d = g.x.shape
    rng = np.random.default_rng(n)
    at = rng.permutation(n)[:rows]
    side = rng.normal(size=(len(at), d)).astype(np.float32)
    side -= (side * g.x[at]).sum(axis=1, keepdims=True) * g.x[at]
    length = np.linalg.norm(side, axis=1, keepdims=True)
    q = threshold * g.x[at] + np.sqrt(1 - threshold**2) * side / np.where(length > 0, length, 1)
    width = first
    while width < n:
        found, _ = search(g, q.astype(np.float32), width)
        if (found == at[:, None]).any(axis=1).mean() >= recall:
            break
        width *= 2
    return width
