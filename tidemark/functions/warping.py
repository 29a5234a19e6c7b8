"""Dynamic time warping of batches of window pairs with numpy.

All pairs of a batch share their lengths and are advanced together: a row of
the cost table (asymmetric steps) or an anti-diagonal (symmetric steps) is one
numpy operation over every pair. Distances are exact; bands only leave out
cells the definition excludes.
"""

from __future__ import annotations

import numpy as np

CELLS = 500_000  # point differences (cells times channels) held at once, about 4 MB an array


def band(p: int, s: int, window: int | None, closed: bool = True) -> np.ndarray:
    """Cells with i - window <= j <= i + window; ``closed`` False leaves out the upper edge."""
    w = s if window is None else window
    i, j = np.arange(p)[:, None], np.arange(s)[None, :]
    return (j >= i - w) & ((j <= i + w) if closed else (j < i + w))


def point_cost(a: np.ndarray, b: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Cost (pair, p, s) between all points of a (pair, p, channel) and b (pair, s, channel)."""
    gap = a[:, :, None, :] - b[:, None, :, :]
    if metric == "euclidean":
        return np.sqrt(np.sum(np.multiply(gap, gap, out=gap), axis=-1))
    if metric == "sqeuclidean":
        return np.sum(np.multiply(gap, gap, out=gap), axis=-1)
    if metric == "cityblock":
        return np.sum(np.abs(gap, out=gap), axis=-1)
    raise ValueError(f"unknown metric {metric!r}")


def descriptor_length(n: int, ratio: float = 0.05) -> int:
    """Length of local descriptors: a share of the window, at least 5 and at most 100."""
    return int(np.clip(np.round(n * ratio), 5, 100))


def describe(x: np.ndarray, size: int) -> np.ndarray:
    """Local descriptor (edge-padded neighbourhood) of every point, channels flattened."""
    front, back = int(np.ceil(size / 2)), int(np.floor(size / 2))
    padded = np.pad(x, ((0, 0), (front, back), (0, 0)), mode="edge")
    parts = [padded[:, k : k + x.shape[1], :] for k in range(size)]
    return np.concatenate(parts, axis=2)


def cumulate(cost: np.ndarray, steps: str, window: int | None) -> np.ndarray:
    """Cumulative cost with one extra leading row and column."""
    n, p, s = cost.shape
    out = np.full((n, p + 1, s + 1), np.inf)
    out[:, 0, 0] = 0.0
    inside = band(p + 1, s + 1, window)
    if steps == "asymmetric":
        w = s if window is None else window
        for i in range(1, p + 1):
            above = out[:, i - 1]
            best = above[:, 1:].copy()
            best = np.minimum(best, above[:, :-1])
            best[:, 1:] = np.minimum(best[:, 1:], above[:, :-2])
            row = cost[:, i - 1] + best
            allowed = inside[i, 1:].copy()
            allowed[0] = i <= w + 1
            out[:, i, 1:] = np.where(allowed, row, np.inf)
        return out
    if steps == "symmetric":
        for d in range(2, p + s + 1):
            i = np.arange(max(1, d - s), min(p, d - 1) + 1)
            j = d - i
            ok = inside[i, j]
            i, j = i[ok], j[ok]
            if len(i):
                best = np.minimum(np.minimum(out[:, i - 1, j - 1], out[:, i, j - 1]), out[:, i - 1, j])
                out[:, i, j] = cost[:, i - 1, j - 1] + best
        return out
    raise ValueError(f"unknown step pattern {steps!r}")


# Moves (rows back, columns back) of each step pattern, in the order ties prefer.
MOVES = {"symmetric": ((1, 1), (1, 0), (0, 1)), "asymmetric": ((1, 0), (1, 1), (1, 2))}


def traces(tables: np.ndarray, steps: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Warping paths of a batch of tables, all walked back from their last cell together."""
    n, rows, cols = tables.shape
    pair = np.arange(n)
    i, j = np.full(n, rows - 1), np.full(n, cols - 1)
    seen, length = [(i - 1, j - 1)], np.ones(n, dtype=int)
    moves = np.array(MOVES[steps])
    while True:
        active = (i > 1) | (j > 1) if steps == "symmetric" else i > 1
        if not active.any():
            break
        costs = []
        for di, dj in MOVES[steps]:
            inside = (i >= di) & (j >= dj)
            costs.append(np.where(inside, tables[pair, np.maximum(i - di, 0), np.maximum(j - dj, 0)], np.inf))
        move = moves[np.argmin(costs, axis=0)]
        i, j = np.where(active, i - move[:, 0], i), np.where(active, j - move[:, 1], j)
        seen.append((i - 1, j - 1))
        length += active
    all_i, all_j = np.array([s[0] for s in seen]), np.array([s[1] for s in seen])
    return [(all_i[:m, k][::-1], all_j[:m, k][::-1]) for k, m in enumerate(length)]


def pair_cost(a: np.ndarray, b: np.ndarray, window: int | None, shape: bool, metric: str = "euclidean") -> np.ndarray:
    """Point cost, or descriptor cost for the shape form, with cells outside the band at infinity."""
    if shape:
        size = descriptor_length(a.shape[1])
        if size != descriptor_length(b.shape[1]):
            raise ValueError("windows differ too much in length for one descriptor size")
        cost = point_cost(describe(a, size), describe(b, size), metric)
    else:
        cost = point_cost(a, b, metric)
    return np.where(band(a.shape[1], b.shape[1], window, closed=not shape), cost, np.inf)


def pairs_at_once(p: int, s: int, channels: int) -> int:
    return max(1, CELLS // max(1, p * s * channels))


def dtw_tables(a: np.ndarray, b: np.ndarray, steps: str, window: int | None, shape: bool = False):
    """Yield (first pair, cumulative tables) for memory-bounded parts of a batch."""
    per = pairs_at_once(a.shape[1], b.shape[1], a.shape[2] * (descriptor_length(a.shape[1]) if shape else 1))
    for at in range(0, len(a), per):
        yield at, cumulate(pair_cost(a[at : at + per], b[at : at + per], window, shape), steps, window)


def dtw_distances(a: np.ndarray, b: np.ndarray, steps: str, window: int | None, shape: bool = False) -> np.ndarray:
    parts = [t[:, -1, -1] for _, t in dtw_tables(a, b, steps, window, shape)]
    return np.concatenate(parts) if parts else np.zeros(0)


def point_length(gap: np.ndarray) -> np.ndarray:
    """Distance of points from their gaps (..., channel, pair), which are overwritten."""
    if gap.shape[-2] == 1:
        return np.abs(gap[..., 0, :], out=gap[..., 0, :])
    return np.sqrt(np.sum(np.multiply(gap, gap, out=gap), axis=-2))


def front_distances(backwards: np.ndarray, b: np.ndarray, window: int) -> np.ndarray:
    """Distances by symmetric steps of windows of one length, holding two fronts of the band and no table.

    Both arrays are (time, channel, pair), the first one from its last point to its first: the points
    that meet on an anti-diagonal then lie in the same order in both. A cell without a number (a point
    is missing, or both are infinite) lets no path through, as in SQL, where NaN is the largest number.
    """
    n, _, pairs = b.shape
    if not n:
        return np.zeros(pairs)
    w = min(window, n - 1)
    # a cell has the place of the one before it on its diagonal, two fronts ago, and overwrites it; places beside the band stay infinite
    new, last = (np.full((w + 3, pairs), np.inf) for _ in range(2))
    gaps = np.empty((w + 1, *b.shape[1:]))
    with np.errstate(invalid="ignore", over="ignore"):
        for d in range(2 * n - 1):
            first = (d - w + 1) // 2
            lo, hi = max(0, d - n + 1, first), min(n - 1, d, (d + w) // 2)
            at, m, odd = lo - first + 1, hi - lo + 1, (d - w) % 2
            gap = np.subtract(backwards[n - 1 - d + lo : n - d + hi], b[lo : hi + 1], out=gaps[:m])
            cells = new[at : at + m]
            if d:
                np.fmin(cells, last[at + odd - 1 : at + odd - 1 + m], out=cells)
                np.fmin(cells, last[at + odd : at + odd + m], out=cells)
                np.add(cells, point_length(gap), out=cells)
            else:
                cells[:] = point_length(gap)
            new, last = last, new
    return last[w // 2 + 1].copy()


def dtw_paths(a: np.ndarray, b: np.ndarray, steps: str, window: int | None, shape: bool = False) -> list:
    out = []
    for _, tables in dtw_tables(a, b, steps, window, shape):
        out += traces(tables, steps)
    return out


def grouped(a: list, b: list, fn) -> list:
    """Apply a batch function to pairs of any lengths, in memory-bounded batches of equal shapes."""
    groups: dict[tuple, list[int]] = {}
    for at, (u, v) in enumerate(zip(a, b, strict=True)):
        groups.setdefault((u.shape, v.shape), []).append(at)
    out: list = [None] * len(a)
    for (left, right), members in groups.items():
        per = pairs_at_once(left[0], right[0], left[1])
        for begin in range(0, len(members), per):
            rows = members[begin : begin + per]
            for at, value in zip(rows, fn(np.stack([a[k] for k in rows]), np.stack([b[k] for k in rows])), strict=True):
                out[at] = value
    return out


def distances_of(a: list, b: list, steps: str, window: int | None, shape: bool = False) -> list:
    return grouped(a, b, lambda x, y: dtw_distances(x, y, steps, window, shape))


def paths_of(a: list, b: list, steps: str, window: int | None, shape: bool = False) -> list:
    return grouped(a, b, lambda x, y: dtw_paths(x, y, steps, window, shape))


def weighted_dtw(
    a: np.ndarray, b: np.ndarray, metric: str = "euclidean", warp: int = 1, window: int | None = None, weight: float = 1.0
) -> np.ndarray:
    """DTW with moves of up to ``warp`` cells and a weight on off-diagonal moves; returns the tables.

    With C the point costs and D the result, inside the band

        D[i, j] = C[i, j] + min(D[i-1, j-1], weight * D[p, j-1], weight * D[i-1, q])

    for p = i .. i+warp-1 and q = j .. j+warp-1, cut at the table's end; D[p, j-1] for
    p > i is not known yet and stands for C[p, j-1]. Cells with equal warp * i + j
    depend on earlier such fronts only, so a front of all tables is one step.
    """
    cost = point_cost(a, b, metric)
    n, r, c = cost.shape
    if window is not None and window < abs(r - c):
        raise ValueError("window is smaller than the difference in length")
    inside = np.ones((r, c), bool) if window is None else band(r, c, window)
    table = np.full((n, r + 1, c + 1), np.inf)
    table[:, 0, 0] = 0.0
    table[:, 1:, 1:] = np.where(inside, cost, np.inf)
    rows, cols = np.nonzero(inside)
    front = warp * rows + cols
    order = np.argsort(front, kind="stable")
    reach = np.arange(1, warp + 1)[:, None]
    for cells in np.split(order, np.flatnonzero(np.diff(front[order])) + 1):
        i, j = rows[cells], cols[cells]
        sideways = table[:, np.minimum(i + reach, r), j].min(axis=1)
        downward = table[:, i, np.minimum(j + reach, c)].min(axis=1)
        table[:, i + 1, j + 1] = cost[:, i, j] + np.minimum(table[:, i, j], weight * np.minimum(sideways, downward))
    return table


def stretch(x: np.ndarray, length: int) -> np.ndarray:
    """Linear resampling of (time, channel) to ``length`` points."""
    at = np.linspace(0, length - 1.0, num=len(x))
    grid = np.arange(length)
    return np.stack([np.interp(grid, at, x[:, c]) for c in range(x.shape[1])], axis=1)
