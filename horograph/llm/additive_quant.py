"""Additive quantisation for nearest neighbours in the Poincare ball.

Points are lifted to the hyperboloid, where cosh(distance) is the Minkowski
product ``q0*y0 - q'.y'``.  A first, coarse codebook (Lorentz k-means) splits
the collection into cells; inside a cell every point is carried into the frame
of the cell's centre and its unit direction is written as a sum of
full-dimensional codewords found by beam search.  The exact norm is stored with
the codes, so a score is one stored norm and ``m`` table look-ups per pair.
The best approximate candidates of all probed cells are then ranked exactly.

Everything here is NumPy on bounded blocks; the Spark side is in ``neighbors``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

#: A cell is crowded beyond so many times the rows wanted in one; a centre is fitted on so many rows at least.
CROWDED, LEAST_FIT = 4, 16


def lift(x: np.ndarray) -> np.ndarray:
    """Ball points (n, d) to hyperboloid points (n, d + 1)."""
    n2 = (x * x).sum(axis=1, keepdims=True)
    gap = 1.0 - n2
    return np.hstack([(1.0 + n2) / gap, 2.0 * x / gap])


def to_frame(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The boost that carries the centre ``c`` to the origin, applied to rows of ``h``."""
    space = c[1:]
    along = h[:, 1:] @ space
    out = np.empty_like(h)
    out[:, 0] = c[0] * h[:, 0] - along
    out[:, 1:] = h[:, 1:] + np.outer(along / (1.0 + c[0]) - h[:, 0], space)
    np.maximum(out[:, 0], 1.0, out=out[:, 0])
    return out


def boost(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``to_frame`` with a centre for each row."""
    along = (h[:, 1:] * c[:, 1:]).sum(axis=1)
    out = np.empty_like(h)
    out[:, 0] = np.maximum(c[:, 0] * h[:, 0] - along, 1.0)
    out[:, 1:] = h[:, 1:] + (along / (1.0 + c[:, 0]) - h[:, 0])[:, None] * c[:, 1:]
    return out


def cosh_to(h: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """cosh(distance) of every row to every centre."""
    flipped = centres.copy()
    flipped[:, 1:] *= -1.0
    return np.maximum(h @ flipped.T, 1.0)


def lorentz_kmeans(h: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = max(1, min(k, len(h)))
    centres = h[rng.choice(len(h), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([cosh_to(b, centres).argmin(axis=1) for b in np.array_split(h, max(1, len(h) // 4096))])
        # far points would dominate a plain mean of lifts: weight each by 1 / cosh(r)
        w = 1.0 / h[:, 0]
        total = np.stack([np.bincount(near, weights=h[:, j] * w, minlength=k) for j in range(h.shape[1])], axis=1)
        size = np.bincount(near, minlength=k)
        norm = np.sqrt(np.maximum(total[:, 0] ** 2 - (total[:, 1:] ** 2).sum(axis=1), 1e-300))
        full = (size > 0) & (total[:, 0] > 0)
        centres[full] = total[full] / norm[full, None]
        empty = np.flatnonzero(size == 0)
        if len(empty):
            centres[empty] = h[rng.choice(len(h), len(empty))]
    centres[:, 0] = np.sqrt(1.0 + (centres[:, 1:] ** 2).sum(axis=1))
    return centres


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = max(1, min(k, len(x)))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None] - 2.0 * x @ c.T).argmin(axis=1)
        size = np.bincount(near, minlength=k)
        for j in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, j], minlength=k)
            c[size > 0, j] = s[size > 0] / size[size > 0]
    return c


def encode(units: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Beam search: codes (n, m) of the sums of codewords nearest to ``units``."""
    n, (m, k, d) = len(units), books.shape
    if n == 0:
        return np.zeros((0, m), np.uint8)
    books = books.astype(np.float32)
    rest = units.astype(np.float32)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for level in range(m):
        book = books[level]
        score = rest @ (-2.0 * book.T)
        score += (book * book).sum(axis=1)
        score += (rest * rest).sum(axis=2)[:, :, None]
        flat = score.reshape(n, -1)
        keep = min(beam if level < m - 1 else 1, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep > 1 else flat.argmin(axis=1)[:, None]
        origin, word = best // k, best % k
        codes = np.concatenate([np.take_along_axis(codes, origin[:, :, None], axis=1), word[:, :, None].astype(np.uint8)], axis=2)
        rest = np.take_along_axis(rest, origin[:, :, None], axis=1) - book[word]
    return codes[:, 0]


def from_frame(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The inverse of ``to_frame``."""
    back = c.copy()
    back[1:] *= -1.0
    return to_frame(z, back)


def nearest_centre(h: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    return np.concatenate([cosh_to(h[s : s + block], centres).argmin(axis=1) for s in range(0, len(h), block)]) if len(h) else np.zeros(0, np.int64)


def split_cell(h: np.ndarray, centre: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """Centres of the ``parts`` cells that take the place of a crowded one with the rows ``h``."""
    return from_frame(lorentz_kmeans(to_frame(h, centre), parts, 6, seed), centre)


def fit_cells(h: np.ndarray, rows: int, cell_rows: int, seed: int) -> np.ndarray:
    """Centres fitted on a sample ``h`` of a collection of ``rows``; cells that would be crowded are split while the sample has the rows for it."""
    scale = rows / max(1, len(h))
    centres = lorentz_kmeans(h, max(1, min(rows // cell_rows, len(h) // LEAST_FIT)), 8, seed)
    for k in range(8):
        near = nearest_centre(h, centres)
        size = np.bincount(near, minlength=len(centres))
        crowded = np.flatnonzero((size * scale > CROWDED * cell_rows) & (size >= 2 * LEAST_FIT))
        if not len(crowded):
            break
        children = [split_cell(h[near == c], centres[c], min(int(2 * -(-size[c] * scale // cell_rows)), size[c] // LEAST_FIT), seed + k) for c in crowded]
        centres = np.concatenate([np.delete(centres, crowded, axis=0), *children])
    return centres


def fit_books(h: np.ndarray, centres: np.ndarray, levels: int, words: int, seed: int, rounds: int = 8) -> np.ndarray:
    """Residual codebooks (levels, words, d) of the unit directions of ``h`` seen from the centres of their cells."""
    near = nearest_centre(h, centres)
    z = np.concatenate([to_frame(h[near == c], centres[c])[:, 1:] for c in np.unique(near)])
    norm = np.linalg.norm(z, axis=1)
    rest = z[norm > 1e-12] / norm[norm > 1e-12, None]
    if not len(rest):
        rest = np.zeros((1, h.shape[1] - 1))
    rng = np.random.default_rng(seed)
    books = np.zeros((levels, words, h.shape[1] - 1))
    for level in range(levels):
        book = _kmeans(rest, words, rounds, rng)
        books[level, : len(book)] = book
        books[level, len(book) :] = book[:1]
        rest = rest - book[((book * book).sum(axis=1)[None] - 2.0 * rest @ book.T).argmin(axis=1)]
    return books


def choose_probes(h: np.ndarray, rows: int, centres: np.ndarray, k: int, target: float, asks: int, seed: int) -> int:
    """The number of nearest cells that hold a share ``target`` of the neighbours of the sample ``h``, asked by ``asks`` of its rows.

    A row of the sample has ``k * len(h) / rows`` of its ``k`` nearest in it on
    average; taking that number rounded up, and at least one, looks no less far
    than the full collection would, so the share found there is no smaller.
    """
    own = np.random.default_rng(seed).choice(len(h), min(asks, len(h)), replace=False)
    deep = min(max(1, math.ceil(k * len(h) / max(1, rows))), len(h) - 1)
    if deep < 1:
        return 1
    cell = nearest_centre(h, centres)
    ranks = []
    for s in range(0, len(own), 256):
        at = own[s : s + 256]
        c = cosh_to(h[at], h)
        c[np.arange(len(at)), at] = np.inf
        near = np.argpartition(c, deep - 1, axis=1)[:, :deep]
        order = cosh_to(h[at], centres)
        ranks.append((order[:, None, :] < np.take_along_axis(order, cell[near], axis=1)[:, :, None]).sum(axis=2).ravel())
    return int(np.quantile(np.concatenate(ranks), target, method="inverted_cdf")) + 1


@dataclass(frozen=True)
class Quantizer:
    centres: np.ndarray
    books: np.ndarray
    probes: int
    beam: int = 2

    def encode(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cell, codes, norms, probed cells) of every row; the cell comes first among the probed ones.

        ``norms`` holds the norm of the point seen from its cell and the factor
        of its sum of codewords: the norm over the part of that sum that lies
        in the point's direction, so that products come out right on average.
        """
        c = cosh_to(h, self.centres)
        p = min(self.probes, c.shape[1])
        near = np.argpartition(c, p - 1, axis=1)[:, :p]
        near = np.take_along_axis(near, np.take_along_axis(c, near, axis=1).argsort(axis=1), axis=1)
        z = boost(h, self.centres[near[:, 0]])[:, 1:]
        norm = np.linalg.norm(z, axis=1)
        unit = z / np.maximum(norm, 1e-300)[:, None]
        codes = encode(unit, self.books, self.beam)
        along = sum((self.books[level][codes[:, level]] * unit).sum(axis=1) for level in range(len(self.books)))
        return near[:, 0], codes, np.stack([norm, np.where(along > 0.1, norm / np.maximum(along, 0.1), norm)], axis=1).astype(np.float32), near


@dataclass
class Points:
    """The indexed points of some cells, sorted by cell: codes and norms for scoring, vectors for the ranking of the few that are left."""

    cell: np.ndarray
    ids: np.ndarray
    codes: np.ndarray
    norms: np.ndarray
    h: np.ndarray

    def sorted(self) -> "Points":
        o = np.argsort(self.cell, kind="stable")
        return Points(*(a[o] for a in (self.cell, self.ids, self.codes, self.norms, self.h)))


def _scores(q: Quantizer, cell: int, points: Points, a: int, b: int, asks: np.ndarray) -> np.ndarray:
    """Approximate cosh distances (asks, points a..b) of one cell from the stored norms and codes by table look-up."""
    f = to_frame(asks, q.centres[cell]).astype(np.float32)
    look = np.zeros((b - a, len(asks)), np.float32)
    for level in range(q.books.shape[0]):
        look += (q.books[level].astype(np.float32) @ f[:, 1:].T)[points.codes[a:b, level]]
    norm, factor = points.norms[a:b].T
    return (np.sqrt(1.0 + norm * norm)[:, None] * f[:, 0][None] - factor[:, None] * look).T


def search(q: Quantizer, points: Points, asks: np.ndarray, ask_ids: np.ndarray, at: np.ndarray, cell: np.ndarray, k: int, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ask, point id, cosh distance - 1, pairs scored) for the ``k`` nearest points of every ask.

    ``at`` (ascending) and ``cell`` list the cells that each ask probes.  Points
    are scored by look-up; the ``rerank`` best of every ask are ranked exactly.
    Equal distances go to the smaller id, a point is not its own neighbour.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0
    if not len(points.ids) or not len(at):
        return none
    points = points.sorted()
    # which of its probes a row of (at, cell) is
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    slot = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)]))
    order = np.argsort(cell, kind="stable")
    at, cell, slot = at[order], cell[order], slot[order]
    keep = min(rerank, len(points.ids))
    best = np.full((len(asks), int(slot.max()) + 1, keep), np.inf, np.float32)
    point = np.zeros(best.shape, np.int32)
    cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    scored = 0
    for s, e in zip(cuts, np.r_[cuts[1:], len(cell)]):
        a, b = np.searchsorted(points.cell, [cell[s], cell[s] + 1])
        if a == b:
            continue
        step = max(1, 8_000_000 // (b - a))
        for t in range(s, e, step):
            who, which = at[t : min(e, t + step)], slot[t : min(e, t + step)]
            score = _scores(q, int(cell[s]), points, a, b, asks[who])
            scored += score.size
            if b - a <= keep:
                best[who, which, : b - a] = score
                point[who, which, : b - a] = np.arange(a, b)
            else:
                top = np.argpartition(score, keep - 1, axis=1)[:, :keep]
                best[who, which] = np.take_along_axis(score, top, axis=1)
                point[who, which] = a + top
    best, point = best.reshape(len(asks), -1), point.reshape(len(asks), -1)
    out = []
    for s in range(0, len(asks), 1024):
        some, cand = best[s : s + 1024], point[s : s + 1024]
        if keep < some.shape[1]:
            top = np.argpartition(some, keep - 1, axis=1)[:, :keep]
            some, cand = np.take_along_axis(some, top, axis=1), np.take_along_axis(cand, top, axis=1)
        # cosh d - 1 = (|y' - q'|^2 - (y0 - q0)^2) / 2, free of the cancellation of the product
        diff = points.h[cand] - asks[s : s + 1024, None]
        diff *= diff
        c = np.maximum(0.5 * (diff[:, :, 1:].sum(axis=2) - diff[:, :, 0]), 0.0)
        ids = points.ids[cand]
        c[(some == np.inf) | (ids == ask_ids[s : s + 1024, None])] = np.inf
        row, column = nearest_of(c, ids, k)
        out.append((row + s, ids[row, column], c[row, column]))
    return *(np.concatenate(x) for x in zip(*out)), scored


def nearest_of(c: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``k`` smallest finite values of every row, equal values by id, in order."""
    if k < c.shape[1]:
        edge = np.partition(c, k - 1, axis=1)[:, k - 1 : k]
        row, column = np.nonzero((c <= edge) & (c < np.inf))
    else:
        row, column = np.nonzero(c < np.inf)
    order = np.lexsort((ids[row, column], c[row, column], row))
    row, column = row[order], column[order]
    start = np.searchsorted(row, np.arange(len(c)))
    near = np.arange(len(row)) - start[row] < k
    return row[near], column[near]
