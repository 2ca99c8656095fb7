"""Lloyd's passes within one cell: groups of neighbouring points against a tree of boxes of centres, many pairs at once.

Points are put into the order of a balanced k-d tree, so that a run of them lies together; centres begin at points and
keep that order, so that runs of them make a tree of boxes, which is measured anew as they move. A group looks at its
own centres first and then at the boxes that reach into the distance found. Work is near to points times the log of centres.
"""

from __future__ import annotations

import numpy as np

#: Points of a group, centres of a box, boxes of the next box, groups and pairs of group and box that are looked at together.
GROUP, CENTRES, FAN, AT_ONCE, PAIRS = 16, 8, 8, 2048, 1024
NONE = np.iinfo(np.int64).max


def ordered(p: np.ndarray, run: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """(order, p[order]): any run of run * 2 ** j points that begins at a multiple of that is a half by the longest side."""
    n, order, axes, size = len(p), np.arange(len(p)), np.array(p.T, order="C"), run
    while size < n:
        size *= 2
    while size > run:
        half, whole = size // 2, n // size
        for start, rows, width in ((0, whole, size), (whole * size, 1, n - whole * size)):
            if not rows or width <= half:
                continue
            part = slice(start, start + rows * width)
            own = axes[:, part].reshape(3, rows, width)
            side = (own.max(2) - own.min(2)).argmax(0)
            by = np.argpartition(own[side, np.arange(rows)], half, 1)
            by = (by + np.arange(rows)[:, None] * width).ravel()
            order[part] = order[part][by]
            for v in axes:
                v[part] = v[part][by]
        size = half
    return order, np.ascontiguousarray(axes.T)


def first_of_equals(c: np.ndarray) -> np.ndarray:
    """Which rows are the first at their place, in the order given."""
    bits = np.ascontiguousarray(c + 0.0).view(np.uint64)  # no -0.0
    mixed = (bits[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ bits[:, 1]) * np.uint64(0xC2B2AE3D27D4EB4F) ^ bits[:, 2]
    rising = np.sort(mixed)
    twice = rising[1:][rising[1:] == rising[:-1]]
    keep = np.ones(len(c), bool)
    if len(twice):
        some = np.flatnonzero(np.isin(mixed, twice))
        by = np.lexsort((some, *c[some].T))
        same = (c[some[by[1:]]] == c[some[by[:-1]]]).all(1)
        keep[some[by[1:][same]]] = False
    return keep


def tree(c: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Boxes (low, high) of each level over runs of centres (boxes, centres, 3), the coarsest first."""
    out = [(c.min(1), c.max(1))]
    while len(out[-1][0]) > FAN:
        low, high = out[-1]
        short = -len(low) % FAN
        grown = [np.concatenate([v, np.full((short, 3), empty)]).reshape(-1, FAN, 3) for v, empty in ((low, np.inf), (high, -np.inf))]
        out.append((grown[0].min(1), grown[1].max(1)))
    return out[::-1]


def squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (CENTRES, pairs, GROUP) of q (3, pairs, GROUP) and c (3, CENTRES, pairs)."""
    out = q[0] - c[0][:, :, None]
    out *= out
    for a in (1, 2):
        d = q[a] - c[a][:, :, None]
        d *= d
        out += d
    return out


class Groups:
    """Points in the order of ordered(), and the nearest centre of each as far as it is known."""

    def __init__(self, p: np.ndarray) -> None:
        self.n, short = len(p), -len(p) % GROUP
        full = np.concatenate([p, np.repeat(p[-1:], short, 0)]).reshape(-1, GROUP, 3)
        self.low, self.high, self.q = full.min(1), full.max(1), np.ascontiguousarray(full.transpose(2, 0, 1))
        self.label, self.bound, self.number = np.full((len(full), GROUP), -1), np.full(len(full), np.inf), None

    def coordinates(self, a: int) -> np.ndarray:
        return self.q[a].ravel()[: self.n]

    def assign(self, at: np.ndarray, c: np.ndarray, moved: np.ndarray | None = None) -> np.ndarray:
        """The number of the nearest of c for each point, the first of equals.

        ``at`` is where in the order each centre began, the same in every call. With ``moved``, which of c are elsewhere than at the call before, only
        groups are looked at of which a point's centre moved, or into whose distances one of those reaches.
        """
        if self.number is None:
            self.number = np.argsort(at, kind="stable")
        seen, number = first_of_equals(c), self.number
        groups = np.arange(len(self.low)) if moved is None else self._touched(c[number[(moved & seen)[number]]], moved)
        if not len(groups):
            return self.label.ravel()[: self.n]
        number = number[seen[number]]
        places = at[number]
        runs = np.concatenate([number, np.repeat(number[-1:], -len(number) % CENTRES)]).reshape(-1, CENTRES)
        levels, numbers, coordinates = tree(c[runs]), np.ascontiguousarray(runs.T), np.ascontiguousarray(c[runs].transpose(2, 1, 0))
        for a in range(0, len(groups), AT_ONCE):
            self._look(groups[a : a + AT_ONCE], places, levels, numbers, coordinates)
        return self.label.ravel()[: self.n]

    def _touched(self, c: np.ndarray, moved: np.ndarray) -> np.ndarray:
        hit = moved[self.label].any(1)
        if len(c):
            levels = tree(c[:, None])  # they may lie far from each other
            rest = np.flatnonzero(~hit)
            for a in range(0, len(rest), AT_ONCE):
                some = rest[a : a + AT_ONCE]
                hit[some[self._reached(some, self.bound[some], levels)[0]]] = True
        return np.flatnonzero(hit)

    def _reached(self, groups: np.ndarray, bound: np.ndarray, levels: list) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a group (its place in groups, rising) and a finest box that is no farther than the group's bound."""
        low, high = self.low[groups], self.high[groups]
        g, box = np.repeat(np.arange(len(groups)), len(levels[0][0])), np.tile(np.arange(len(levels[0][0])), len(groups))
        for i, (lo, hi) in enumerate(levels):
            if i:
                g, box = np.repeat(g, FAN), (box[:, None] * FAN + np.arange(FAN)).ravel()
                there = box < len(lo)
                g, box = g[there], box[there]
            far = np.zeros(len(g))
            for a in range(3):
                away = np.maximum(np.maximum(lo[box, a] - high[g, a], low[g, a] - hi[box, a]), 0)
                away *= away
                far += away
            near = far <= bound[g]
            g, box = g[near], box[near]
        return g, box

    def _look(self, groups: np.ndarray, places: np.ndarray, levels: list, numbers: np.ndarray, coordinates: np.ndarray) -> None:
        q, last = self.q[:, groups], len(places) - 1
        one = np.minimum(np.searchsorted(places, groups * GROUP), last) // CENTRES
        two = np.minimum(np.maximum(np.searchsorted(places, (groups + 1) * GROUP) - 1, 0), last) // CENTRES
        d, e = squares(q, coordinates[:, :, one]), squares(q, coordinates[:, :, two])
        best = np.minimum(d.min(0), e.min(0))
        label = np.minimum(np.where(d == best, numbers[:, one, None], NONE).min(0), np.where(e == best, numbers[:, two, None], NONE).min(0))
        wide = lambda v: v.max(1) * (1 + 1e-9) + 1e-300  # noqa: E731  more than rounding can take
        g, box = self._reached(groups, wide(best), levels)
        other = (box != one[g]) & (box != two[g])
        g, box = g[other], box[other]
        found = []
        for a in range(0, len(g), PAIRS):
            gs, boxes = g[a : a + PAIRS], box[a : a + PAIRS]
            d = squares(q[:, gs], coordinates[:, :, boxes])
            least = d.min(0)
            hit = np.flatnonzero((least <= best[gs]).any(1))
            if len(hit):
                found.append((gs[hit], least[hit], np.where(d[:, hit] == least[hit], numbers[:, boxes[hit], None], NONE).min(0)))
        if found:
            g, least, which = (np.concatenate(v) for v in zip(*found))
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            own, of = g[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(g))))
            lower = np.minimum(best[own], np.minimum.reduceat(least, first, 0))
            which = np.minimum.reduceat(np.where(least == lower[of], which, NONE), first, 0)
            label[own] = np.minimum(np.where(best[own] == lower, label[own], NONE), which)
            best[own] = lower
        self.label[groups], self.bound[groups] = label, wide(best)
