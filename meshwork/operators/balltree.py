"""A tree over balls that many rays walk at once.

The squared distance of a ray from a centre, less the squared radius, is a product of
eleven numbers of the ray with eleven of the ball: rays meet the balls of a leaf, or the
parts of a node, in one matrix product. A product within its rounding error of the bound, or that
is no number, decides nothing; such pairs, and those that may be a ray's nearest, are tested by the plain formula.
"""

from __future__ import annotations

import numpy as np

#: Balls of a leaf at most (their number fits a byte), and rays that meet a leaf at once.
LEAF = 128
AT_ONCE = 2_048
#: Halvings between a node and its parts.
HALVINGS = 3
#: Rounding of a product, as a share of the squared scale: some hundred units in the last place.
ROUNDING = 2.0**-44


def _lifted(at: np.ndarray, reach: np.ndarray) -> np.ndarray:
    x, y, z = at.T
    square = x * x + y * y + z * z - reach * reach
    return np.stack([square, -2 * x, -2 * y, -2 * z, -x * x, -y * y, -z * z, -2 * x * y, -2 * x * z, -2 * y * z, np.ones(len(at))], axis=1)


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    # in the order of the plain formula, so that results are the same to the last bit
    return a[:, 0] * b[:, 0] + a[:, 1] * b[:, 1] + a[:, 2] * b[:, 2]


def _count(within: np.ndarray) -> np.ndarray:
    return np.add.reduce(within.view(np.uint8), axis=0, dtype=np.uint8).astype(np.int64)


class BallTree:
    """Balls halved along the longest side, down to leaves; a node knows a centre and how far its balls reach from it."""

    def __init__(self, ids: np.ndarray, at: np.ndarray, radius: np.ndarray, copies: np.ndarray):
        self.middle = (at.min(0) + at.max(0)) / 2
        order, moved, reach = np.arange(len(at)), np.ascontiguousarray((at - self.middle).T), np.abs(radius)
        self.spans: list[tuple[int, int]] = []
        self.parts: list[np.ndarray | None] = []
        centres: list[np.ndarray] = []
        reaches: list[float] = []

        def halves(low: int, high: int) -> list[tuple[int, int]]:
            if high - low <= LEAF:
                return [(low, high)]
            points, half = moved[:, low:high], (high - low) // 2
            split = np.argpartition(points[(points.max(1) - points.min(1)).argmax()], half)
            moved[:, low:high], order[low:high], reach[low:high] = points[:, split], order[low:high][split], reach[low:high][split]
            return [(low, low + half), (low + half, high)]

        def grow(low: int, high: int) -> int:
            me, points = len(self.spans), moved[:, low:high]
            centre = (points.min(1) + points.max(1)) / 2
            away = points - centre[:, None]
            self.spans.append((low, high))
            self.parts.append(None)
            centres.append(centre)
            reaches.append(float((np.sqrt((away * away).sum(0)) + reach[low:high]).max()))
            parts = [(low, high)]
            for _ in range(HALVINGS):
                parts = [half for part in parts for half in halves(*part)]
            if len(parts) > 1:
                self.parts[me] = np.array([grow(*part) for part in parts])
            return me

        grow(0, len(at))
        self.ids, self.at, self.radius, self.copies = ids[order], at[order], radius[order], copies[order]
        self.centres, self.reaches = np.array(centres), np.array(reaches)
        self.balls, self.nodes = _lifted(moved.T, self.radius), _lifted(self.centres, self.reaches)

    def pick(self, origin: np.ndarray, towards: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of rays with unit directions: the nearest ball's id, its depth and how many are met, 0 where none is.

        Nodes are walked from near to far as seen by the rays on average, so few leaves can improve on the nearest.
        """
        n = len(origin)
        offset = origin - self.middle
        along = _dots(offset, towards)
        foot = offset - along[:, None] * towards
        scale = np.sqrt(_dots(offset, offset)) + self.reaches[0]
        error = ROUNDING * scale * scale
        dx, dy, dz = towards.T
        rays = np.stack([np.ones(n), *foot.T, dx * dx, dy * dy, dz * dz, dx * dy, dx * dz, dy * dz, _dots(offset, offset) - along * along], axis=1)
        rays /= error[:, None]  # so that one bound holds for all
        lines = np.concatenate([towards, along[:, None], (ROUNDING * scale)[:, None]], axis=1)
        # a ball of radius 0 may be met from as far away as the root of the error
        bounds = 2 + 2 * self.reaches / np.sqrt(np.nanmin(error))
        far = self.centres @ np.nan_to_num(towards).mean(0)
        depth, nearest, hits = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        stack = [(0, np.flatnonzero(~(rays @ self.nodes[0] > bounds[0])))]
        while stack:
            k, mine = stack.pop()
            if self.parts[k] is None:
                for first in range(0, len(mine), AT_ONCE):
                    self._leaf(k, mine[first : first + AT_ONCE], origin, towards, rays, lines, depth, nearest, hits)
            elif len(mine):
                parts = self.parts[k][np.argsort(-far[self.parts[k]])]
                near = ~(self.nodes[parts] @ np.take(rays, mine, axis=0).T > bounds[parts][:, None])
                stack += [(part, mine[row]) for part, row in zip(parts.tolist(), near)]
        return nearest, depth, hits

    def _leaf(
        self, k: int, mine: np.ndarray, origin: np.ndarray, towards: np.ndarray, rays: np.ndarray, lines: np.ndarray, depth: np.ndarray, nearest: np.ndarray, hits: np.ndarray
    ) -> None:
        low, high = self.spans[k]
        found = self.balls[low:high] @ np.take(rays, mine, axis=0).T
        within = ~(found > 1)
        many = _count(within)
        some = np.flatnonzero(many)
        if not len(some):
            return
        sure, many, mine = (_count(found <= -1) == many)[some], many[some], mine[some]
        line = np.take(lines, mine, axis=0)
        centre = line[:, :3] @ self.centres[k] - line[:, 3]
        plain = sure & (centre - self.reaches[k] > line[:, 4])
        copies = self.copies[low:high]
        met = many * copies[0] if (copies == copies[0]).all() else (copies.astype(np.float64) @ within[:, some]).astype(np.int64)
        hits[mine[plain]] += met[plain]
        # what the plain formula must tell: how many are met, or which is nearest
        asked = ~plain | (centre - self.reaches[k] - line[:, 4] <= depth[mine])
        asked &= ~(centre + self.reaches[k] + line[:, 4] < 0)
        ray, ball = np.nonzero(within[:, some[asked]].T)
        whose = mine[asked][ray]
        ball += low
        away = np.take(self.at, ball, axis=0) - np.take(origin, whose, axis=0)
        deep = _dots(away, np.take(towards, whose, axis=0))
        met = (deep > 0) & (_dots(away, away) - deep * deep <= self.radius[ball] * self.radius[ball])
        ball, whose, deep, counted = ball[met], whose[met], deep[met], ~plain[asked][ray[met]]
        if not len(whose):
            return
        np.add.at(hits, whose[counted], self.copies[ball[counted]])
        begins = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        least = np.minimum.reduceat(deep, begins)
        equal = deep == np.repeat(least, np.diff(begins, append=len(deep)))
        ball = np.minimum.reduceat(np.where(equal, self.ids[ball], np.iinfo(np.int64).max), begins)
        whose = whose[begins]
        nearer = (least < depth[whose]) | ((least == depth[whose]) & (ball < nearest[whose]))
        depth[whose[nearer]], nearest[whose[nearer]] = least[nearer], ball[nearer]
