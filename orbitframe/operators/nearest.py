"""Search for the nearest of many bodies in orbit, each object at its own time."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from orbitframe import constants as K
from orbitframe.functions import orbits
from orbitframe.functions.motion import NEWTON_STEPS, motion
from orbitframe.operators.trajectory import ELEMENTS

OBJECT = ["norad_id", "us", "rx", "ry", "rz"]
ASSET = ["asset_id", "asset_name", *(f"el_{c}" for c in ELEMENTS)]
PAIR = "norad_id long, us long, rx double, ry double, rz double, asset_id long, asset_name string, " + \
    ", ".join(f"el_{c} {'long' if c == 'epoch' else 'double'}" for c in ELEMENTS)
#: what arithmetic in two languages may differ by, km
MARGIN_KM = 1e-3


def finder(tile: int = 192, together: int = 512, most_pairs: int = 4_000_000, least: int = 64,
           span_s: float = 60.0, longest_s: float = 600.0):
    """``find(objects, assets)``: the pairs of an object with each asset that may be its nearest one.

    Objects are taken in order of time, those within ``span_s`` together (within ``longest_s`` while
    they are fewer than ``least``). Assets are placed at the middle of that span; none is farther from
    there than its speed allows. The places are halved again and again into boxes of about ``tile``
    assets. An object visits the boxes from the nearest one on until the next is farther off than an
    asset can be that is surely usable; what remains is placed at the object's own time. Pairs that
    are within a margin of the least distance, or of a limit, are all told.

    It carries all it uses, so tasks need not import this module.
    """
    position, margin, same, earth = motion(), MARGIN_KM, K.SAME_STRUCTURE_KM, K.R_EARTH_KM
    mu, drift, two_pi, newton = K.MU_KM3_S2, 1.5 * K.J2 * K.R_EARTH_KM ** 2, orbits.TWO_PI, NEWTON_STEPS
    object_columns, asset_columns, width = OBJECT, ASSET, len(ELEMENTS)

    def anomaly_errors():
        """Eccentricities, and what the anomaly may be off by after the Newton steps for any up to each."""
        ecc = np.concatenate([np.arange(0.0, 0.9, 0.02), np.arange(0.9, 0.9901, 0.002)])[:, None]
        m = np.concatenate([np.geomspace(1e-6, 0.5, 1500), np.linspace(0.5, np.pi, 500)])[None, :]
        e = m + ecc * np.sin(m)
        for _ in range(newton):
            e = e - (e - ecc * np.sin(e) - m) / (1 - ecc * np.cos(e))
        low, high = np.zeros_like(e), np.full_like(e, np.pi)
        for _ in range(60):
            middle = (low + high) / 2
            left = middle - ecc * np.sin(middle) < m
            low, high = np.where(left, middle, low), np.where(left, high, middle)
        return ecc[:, 0], 2 * np.maximum.accumulate(np.abs(e - low).max(axis=1)) + 1e-12

    def bounds(elements):
        """Least radius, greatest speed, and what a computed place may be off by, of each asset."""
        _, _, _, ecc, _, _, revs = elements
        n = revs * two_pi / 86400
        a = (mu / (n * n)) ** (1 / 3)
        p = a * (1 - ecc * ecc)
        speed = n * a * np.sqrt((1 + ecc) / (1 - ecc)) + 3 * drift * n / (p * p) * a * (1 + ecc)
        steps, errors = anomaly_errors()
        at = np.searchsorted(steps, ecc)
        off = np.where(at < len(steps), errors[np.minimum(at, len(steps) - 1)], np.inf)
        return a * (1 - ecc), speed, 2 * a * off

    def boxes(place, slack):
        """Numbers of assets by box, all boxes of one size; an asset may come twice to fill them."""
        count = len(slack)
        levels = max(0, int(np.ceil(np.log2(max(1, count / tile)))))
        size = -(-count // 2 ** levels)
        order = np.resize(np.arange(count), (1, size * 2 ** levels))
        where = np.column_stack([place, np.minimum(slack, 1e9)])
        for _ in range(levels):
            some = where[order]
            axis = np.argmax(some.max(axis=1) - some.min(axis=1), axis=1)
            value = np.take_along_axis(some, axis[:, None, None], axis=2)[:, :, 0]
            half = order.shape[1] // 2
            order = np.take_along_axis(order, np.argpartition(value, half, axis=1), axis=1).reshape(-1, half)
        return order

    def candidates(ids, spots, asset_ids, place, slack, sure, order):
        """(object, asset) numbers, some objects at a time: assets that may be nearest to ``spots``."""
        some, reach = place[order], slack[order].max(axis=1)
        low, high = some.min(axis=1), some.max(axis=1)
        step = max(1, min(together, most_pairs // order.size))
        for at in range(0, len(ids), step):
            me, spot = ids[at:at + step], spots[at:at + step]
            apart = np.zeros((len(me), len(order)))
            for c in range(3):
                gap = np.maximum(low[None, :, c] - spot[:, None, c], spot[:, None, c] - high[None, :, c])
                apart += np.maximum(gap, 0.0) ** 2
            apart = np.sqrt(apart) - reach[None, :]
            turn = np.argsort(apart, axis=1)
            apart = np.take_along_axis(apart, turn, axis=1)
            known = np.full(len(me), np.inf)
            met_o, met_a, met_d = [], [], []
            for k in range(len(order)):
                who = np.flatnonzero(apart[:, k] <= known + margin)
                if not len(who):
                    break  # the boxes after this one are no nearer
                box = turn[who, k]
                them = order[box]
                d = some[box] - spot[who, None, :]
                d = np.sqrt(np.einsum("ijk,ijk->ij", d, d))
                spread = slack[them]
                nearest, farthest = d - spread, d + spread
                other = asset_ids[them] != me[who, None]
                usable = other & sure[them] & (nearest >= same + margin)
                known[who] = np.minimum(known[who], np.where(usable, farthest, np.inf).min(axis=1))
                row, col = np.nonzero(other & (nearest <= known[who, None] + margin))
                met_o.append(who[row]), met_a.append(them[row, col]), met_d.append(nearest[row, col])
            if sum(map(len, met_o)):
                o, a, d = np.concatenate(met_o), np.concatenate(met_a), np.concatenate(met_d)
                kept = d <= known[o] + margin
                yield o[kept] + at, a[kept]

    def nearest(us, spots, elements, kind, o, a):
        """Of these pairs those that may be nearest at the objects' own times; of equal orbits the first."""
        gap, radius = np.empty(len(o)), np.empty(len(o))
        for at in range(0, len(o), 200_000):
            oo, aa = o[at:at + 200_000], a[at:at + 200_000]
            r = np.column_stack(position([e[aa] for e in elements], us[oo]))
            gap[at:at + 200_000] = np.sqrt(((r - spots[oo]) ** 2).sum(axis=1))
            radius[at:at + 200_000] = np.sqrt((r * r).sum(axis=1))
        first = o.min()
        best = np.full(o.max() - first + 1, np.inf)
        clear = (gap >= same + margin) & (radius >= earth + margin)
        np.minimum.at(best, o[clear] - first, gap[clear])
        kept = (gap >= same - margin) & (radius >= earth - margin) & (gap <= best[o - first] + margin)
        o, a = o[kept], a[kept]
        order = np.lexsort((a, kind[a], o))
        o, a = o[order], a[order]
        first = np.ones(len(o), bool)
        first[1:] = (o[1:] != o[:-1]) | (kind[a[1:]] != kind[a[:-1]])
        return o[first], a[first]

    def find(objects: pa.Table, assets: pa.Table) -> pa.Table:
        objects, assets = objects.select(object_columns).sort_by("us"), assets.select(asset_columns)
        if not len(objects) or not len(assets):
            return pa.Table.from_arrays([*objects.slice(0, 0).columns, *assets.slice(0, 0).columns],
                                        names=[*object_columns, *asset_columns])
        # by id and name, a missing name first
        nth = pc.sort_indices(assets, sort_keys=[
            ("asset_id", "ascending"), ("asset_name", "ascending")], null_placement="at_start")
        assets = assets.take(nth)
        column = lambda table, name: table.column(name).to_numpy()
        ids, us = column(objects, "norad_id"), column(objects, "us")
        spots = np.column_stack([column(objects, c) for c in ("rx", "ry", "rz")])
        asset_ids = column(assets, "asset_id")
        elements = [column(assets, c) for c in asset_columns[2:]]
        out_o, out_a = [np.zeros(0, int)], [np.zeros(0, int)]
        with np.errstate(all="ignore"):
            low, speed, off = bounds(elements)
            usable = np.flatnonzero(np.isfinite(np.column_stack(position(elements, elements[0]))).all(axis=1))
            as_bits = np.column_stack([elements[0].astype(float), *elements[1:]]) + 0.0
            kind = np.unique(as_bits.view(np.dtype((np.void, 8 * width))).ravel(), return_inverse=True)[1].ravel()
            start = 0
            while start < len(ids) and len(usable):
                end = np.searchsorted(us, us[start] + int(span_s * 1e6), "right")
                end = max(end, min(start + least, np.searchsorted(us, us[start] + int(longest_s * 1e6), "right")))
                middle = (us[start] + us[end - 1]) // 2
                seconds = (us[end - 1] - us[start]) / 2e6 + 1e-6
                place = np.column_stack(position([e[usable] for e in elements], middle))
                slack = np.zeros(len(usable)) if us[start] == us[end - 1] else (
                    speed[usable] * seconds + off[usable])
                slack = np.where(np.isnan(slack), np.inf, slack)
                for o, a in candidates(ids[start:end], spots[start:end], asset_ids[usable], place, slack,
                                       low[usable] >= earth + 1, boxes(place, slack)):
                    o, a = nearest(us, spots, elements, kind, o + start, usable[a])
                    out_o.append(o), out_a.append(a)
                start = end
        return pa.Table.from_arrays(
            [*objects.take(np.concatenate(out_o)).columns, *assets.take(np.concatenate(out_a)).columns],
            names=[*object_columns, *asset_columns])

    return find
