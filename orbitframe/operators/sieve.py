"""Counting pairs whose altitude bands overlap and whose planes are close, without building them."""

import math

import numpy as np
import pyarrow as pa

ROW = ["id", "low", "high", "incl_deg", "raan_deg", "nx", "ny", "nz"]
COUNTED = "n long, a_incl_deg double, a_raan_deg double, b_incl_deg double, b_raan_deg double"
#: cosines that lie as near to the limit are left to the exact angle
MARGIN = 1e-9


def counter(max_angle_deg: float, tile: int = 512):
    """``count(left, right)``: how many pairs of a row of either side pass; sides of one block are the same.

    The rows of each side are halved again and again into boxes of about ``tile`` plane normals. Two boxes
    that lie wholly within the angle need no angles: overlaps are counted in the order of starts. Two that
    lie wholly beyond it have none, and only the others are compared row by row. Pairs of planes at the
    limit itself are told with their number, for the exact angle to decide.

    It carries all it uses, so tasks need not import this module.
    """
    limit, margin, columns = math.cos(math.radians(max_angle_deg)), MARGIN, ROW

    def in_order(low, ids, known):
        """Number of each row's (low, id) in order; a missing id comes before all others."""
        order = np.lexsort((ids, known, low))
        new = np.ones(len(order), bool)
        same = (low[order][1:] == low[order][:-1]) & (known[order][1:] == known[order][:-1]) & (
            ids[order][1:] == ids[order][:-1])
        new[1:] = ~same
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        return rank

    def spans(low, high, ids, known):
        """Rank of each row, and the ranks from and before which its partners with a later start lie."""
        rank = in_order(low, ids, known)
        order = np.argsort(rank, kind="stable")
        lows, ranks = low[order], np.append(rank[order], rank.max(initial=-1) + 1)
        past = lambda value: ranks[np.searchsorted(lows, value, "right")]
        return np.stack([rank, np.where(known, rank + 1, past(low)), past(high)]).astype(np.int32)

    def boxes(normal):
        """Row numbers by box; -1 fills the last ones."""
        count = len(normal)
        levels = max(0, math.ceil(math.log2(max(1, count / tile))))
        size = -(-count // 2 ** levels)
        order = np.full((1, size * 2 ** levels), -1)
        order[0, :count] = np.arange(count)
        for _ in range(levels):
            some = normal[order]  # a filler stands where the last row does
            axis = np.argmax(some.max(axis=1) - some.min(axis=1), axis=1)
            value = np.take_along_axis(some, axis[:, None, None], axis=2)[:, :, 0]
            half = order.shape[1] // 2
            order = np.take_along_axis(order, np.argpartition(value, half, axis=1), axis=1).reshape(-1, half)
        return order

    def side(normal, span, planes):
        """Boxes of one side: normals, ranks with spans (a filler has none), planes, corners."""
        order = boxes(normal)
        some, held = normal[order], np.where(order >= 0, span[:, order], np.array([-1, 0, 0], np.int32)[:, None, None])
        by_rank = np.argsort(held[0], axis=1)
        some = np.take_along_axis(some, by_rank[:, :, None], axis=1)
        held = np.take_along_axis(held, by_rank[None], axis=2)
        return some, held, planes[np.take_along_axis(order, by_rank, axis=1)], some.min(axis=1), some.max(axis=1)

    def overlaps(a, b):
        """Number of pairs with an interval of ``a`` and a start of ``b``, ranks in order."""
        return int(np.maximum(np.searchsorted(b[0], a[2]) - np.searchsorted(b[0], a[1]), 0).sum())

    def between(a, b, both, told):
        """Pairs with the interval in ``a``, and if ``both`` also those with it in ``b``."""
        total = 0
        near, far = 2 - 2 * limit + 4 * margin, 2 - 2 * limit - 4 * margin
        for i in range(len(a[0])):
            least = most = 0.0
            for c in range(3):
                gap = np.maximum(a[3][i, c] - b[4][:, c], b[3][:, c] - a[4][i, c])
                least = least + np.maximum(gap, 0) ** 2
                most = most + np.maximum(a[4][i, c] - b[3][:, c], b[4][:, c] - a[3][i, c]) ** 2
            for j in np.flatnonzero(least <= near):
                x, y = a[1][:, i], b[1][:, j]
                if most[j] <= far:
                    total += overlaps(x, y) + (overlaps(y, x) if both else 0)
                    continue
                meet = (y[0] >= x[1][:, None]) & (y[0] < x[2][:, None])
                if both:
                    meet |= (x[0][:, None] >= y[1]) & (x[0][:, None] < y[2])
                close = a[0][i] @ b[0][j].T
                meet &= close >= limit - margin
                total += int(np.count_nonzero(meet))
                unsure = meet & (close < limit + margin)
                if unsure.any():
                    p, q = np.nonzero(unsure)
                    total -= len(p)
                    planes, n = np.unique(np.column_stack([a[2][i][p], b[2][j][q]]), axis=0, return_counts=True)
                    told.append(np.column_stack([n, planes]))
        return total

    def answer(total, told):
        told = np.concatenate([[[float(total), 0, 0, 0, 0]], *told])
        sure = np.arange(len(told)) == 0
        return pa.Table.from_arrays(
            [pa.array(told[:, 0].astype(np.int64)), *(pa.array(told[:, k], mask=sure) for k in range(1, 5))],
            names=["n", "a_incl_deg", "a_raan_deg", "b_incl_deg", "b_raan_deg"])

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return answer(0, [])
        one = left.column("i")[0].as_py() == left.column("j")[0].as_py()
        tables = [left] if one else [left, right]
        rows = pa.concat_tables([t.select(columns) for t in tables])
        value = lambda name: rows.column(name).to_numpy()
        known = rows.column("id").is_valid().to_numpy()
        ids = rows.column("id").fill_null(0).to_numpy()
        span = spans(value("low"), value("high"), ids, known)
        normal = np.column_stack([value(c) for c in ("nx", "ny", "nz")])
        planes = np.column_stack([value("incl_deg"), value("raan_deg")])
        first = np.arange(len(rows)) < len(left)
        # planes that are no numbers are at no angle: the exact expression has 0 for it
        whole = np.isfinite(normal).all(axis=1)
        total, told, groups = 0, [], [first] if one else [first, ~first]
        if all((g & whole).any() for g in groups):
            made = [side(normal[g & whole], span[:, g & whole], planes[g & whole]) for g in groups]
            total += between(made[0], made[-1], not one, told)
        if not whole.all():
            at = lambda mask: span[:, mask][:, np.argsort(span[0, mask])]
            odd, even = [at(g & ~whole) for g in groups], [at(g & whole) for g in groups]
            meets = [(odd[0], odd[-1]), (odd[0], even[-1]), (even[0], odd[-1])]
            total += sum(overlaps(a, b) + (0 if one else overlaps(b, a)) for a, b in meets)
        return answer(total, told)

    return count
