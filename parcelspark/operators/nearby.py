"""Points near other points, or inside of regions, through a cover of grid cells (problem 4).

A shape (a polygon, or a disc around a point) is covered by square cells of a few sizes, each a
quarter of the one before. A cell that lies wholly inside of the shape accepts its points at once. A
cell that the outline crosses is parted into 16 × 16 fine cells, kept as two sets of 256 bits: fine
cells inside accept at once too, and only points of fine cells on the outline take the exact test. Cells
are refined along the outline until no more than a target share of the covered area takes that test.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread, written

#: Side of the cells of level 0 in degrees; those of level k are 4^-k of it, down to level LAST.
SIDE, LAST = 327.68, 13
#: Cells are numbered from the origin of the coordinates, up to this number either way.
REACH = 1 << 29
#: Fine cells along a side of a cell.
FINE = 16
EARTH_M = 6_371_008.8
#: A cover of at most so many rows, and shapes with at most so many corners, are broadcast (under 100 MB each); larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_CORNERS = 200_000, 2_000_000
#: Cells times sides that are compared at once.
BLOCK = 4_000_000
#: A shape with more cells on its outline is not refined further; more of it takes the exact test then.
MOST_CELLS = 5_000
COVER = "shape_id bigint, form bigint, level int, cell bigint, filled array<bigint>, edge array<bigint>, share double, area double"


def _side(level: int) -> float:
    return SIDE / 4.0**level


def _pack(level: int, ix: np.ndarray, iy: np.ndarray) -> np.ndarray:
    return np.array(level, np.int64) << np.int64(60) | ((ix.astype(np.int64) + REACH) << 30) | (iy.astype(np.int64) + REACH)


def _words(flags: np.ndarray) -> list[np.ndarray]:
    """Rows of 256 flags as rows of four numbers of 64 bits."""
    return list(np.packbits(flags, axis=1, bitorder="little").view("<i8"))


Judge = Callable[[np.ndarray, np.ndarray, float], np.ndarray]


def cover_of(sid: int, form: int, box: tuple[float, float, float, float], judge: Judge, target: float) -> pd.DataFrame | None:
    """The cover of one shape. judge(x, y, side): 1 inside, 0 crossed, -1 outside, of the cells with that lower left corner."""
    level = 0
    while level < LAST and _side(level) * 1.5 > max(box[2] - box[0], box[3] - box[1], 1e-9):
        level += 1
    s = _side(level)
    ix, iy = (a.ravel() for a in np.meshgrid(np.arange(np.floor(box[0] / s), np.floor(box[2] / s) + 1), np.arange(np.floor(box[1] / s), np.floor(box[3] / s) + 1)))
    whole: list[tuple[int, np.ndarray]] = []
    area = 0.0
    while True:
        s = _side(level)
        kind = judge(ix * s, iy * s, s)
        whole.append((level, _pack(level, ix[kind == 1], iy[kind == 1])))
        area += float((kind == 1).sum()) * s * s
        ix, iy = ix[kind == 0], iy[kind == 0]
        if not len(ix):
            fine = np.zeros((0, FINE * FINE), int)
            break
        sub = np.arange(FINE)
        fx = (ix[:, None, None] * FINE + sub[None, :, None] + np.zeros((1, 1, FINE))).ravel()
        fy = (iy[:, None, None] * FINE + sub[None, None, :] + np.zeros((1, FINE, 1))).ravel()
        t = s / FINE
        fine = judge(fx * t, fy * t, t).reshape(len(ix), FINE * FINE)
        crossed = float((fine == 0).sum()) * t * t
        if level == LAST or len(ix) > MOST_CELLS or crossed <= target * (area + float((fine == 1).sum()) * t * t + crossed):
            area += float((fine == 1).sum()) * t * t + crossed
            break
        four = np.arange(4)  # the outline's cells, at the next level
        ix, iy = (ix[:, None, None] * 4 + four[None, :, None] + np.zeros((1, 1, 4))).ravel(), (iy[:, None, None] * 4 + four[None, None, :] + np.zeros((1, 4, 1))).ravel()
        level += 1
    keep = (fine >= 0).any(axis=1)
    fine, ix, iy = fine[keep], ix[keep], iy[keep]
    cells = [c for _, c in whole] + [_pack(level, ix, iy)]
    levels = np.concatenate([np.full(len(c), k) for k, c in whole] + [np.full(len(ix), level)]).astype(int)
    if not len(levels):
        return None
    n = len(levels) - len(ix)
    t = _side(level) / FINE
    own = np.concatenate([np.zeros(n), (fine == 0).sum(axis=1) * t * t])
    size = np.concatenate([[_side(k) ** 2 for k in levels[:n]], (fine >= 0).sum(axis=1) * t * t])
    return pd.DataFrame({"shape_id": sid, "form": form, "level": levels, "cell": np.concatenate(cells), "filled": [None] * n + _words(fine == 1), "edge": [None] * n + _words(fine == 0), "share": own, "area": size})


def _inside(xs: np.ndarray, ys: np.ndarray, px: np.ndarray, py: np.ndarray) -> np.ndarray:
    """Whether points lie inside of a ring; points of one height share the work, as those of a grid do."""
    heights, row = np.unique(py, return_inverse=True)
    x1, y1, x2, y2 = xs[:-1], ys[:-1], xs[1:], ys[1:]
    out = np.zeros(len(px), bool)
    for lo in range(0, len(heights), max(1, BLOCK // len(x1))):
        hi = min(lo + max(1, BLOCK // len(x1)), len(heights))
        h = heights[lo:hi, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = np.where((y1 > h) != (y2 > h), (x2 - x1) * (h - y1) / (y2 - y1) + x1, -np.inf)
        at = -np.sort(-at, axis=1)[:, : max(1, int((at > -np.inf).sum(axis=1).max(initial=0)))]
        mine = np.flatnonzero((row >= lo) & (row < hi))
        step = max(1, BLOCK // at.shape[1])
        for m in range(0, len(mine), step):
            some = mine[m : m + step]
            out[some] = (px[some, None] < at[row[some] - lo]).sum(axis=1) % 2 == 1
    return out


def _judge_polygon(xs: np.ndarray, ys: np.ndarray) -> Judge:
    x1, y1, x2, y2 = xs[:-1, None], ys[:-1, None], xs[1:, None], ys[1:, None]

    def crossed(cx: np.ndarray, cy: np.ndarray, s: float) -> np.ndarray:
        pad = s * 1e-6
        near = (np.maximum(x1, x2) >= cx - pad) & (np.minimum(x1, x2) <= cx + s + pad) & (np.maximum(y1, y2) >= cy - pad) & (np.minimum(y1, y2) <= cy + s + pad)
        side, cell = np.nonzero(near)
        ax, ay, bx, by, px, py = x1[side, 0], y1[side, 0], x2[side, 0], y2[side, 0], cx[cell], cy[cell]
        turn = [(bx - ax) * (py + dy - ay) - (by - ay) * (px + dx - ax) for dx in (-pad, s + pad) for dy in (-pad, s + pad)]
        apart = np.all([t > 0 for t in turn], axis=0) | np.all([t < 0 for t in turn], axis=0)
        return np.bincount(cell[~apart], minlength=len(cx)) > 0

    def judge(cx: np.ndarray, cy: np.ndarray, s: float) -> np.ndarray:
        step = max(1, BLOCK // len(x1))
        on = np.concatenate([crossed(cx[i : i + step], cy[i : i + step], s) for i in range(0, len(cx), step)])
        return np.where(on, 0, np.where(_inside(xs, ys, cx + s / 2, cy + s / 2), 1, -1))

    return judge


def _metres(x1, y1, x2, y2):
    a, b = np.radians(y1), np.radians(y2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(x2 - x1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1)))


def _judge_disc(x: float, y: float, radius: float) -> Judge:
    def judge(cx: np.ndarray, cy: np.ndarray, s: float) -> np.ndarray:
        far = np.max([_metres(x, y, cx + dx, cy + dy) for dx in (0, s) for dy in (0, s)], axis=0)
        close = _metres(x, y, np.clip(x, cx, cx + s), np.clip(y, cy, cy + s))
        return np.where(far < radius * 0.999, 1, np.where(close > radius * 1.01 + 0.01, -1, 0))

    return judge


def closed(ring: str, axis: str) -> Column:
    """One coordinate of a ring's points, the first one again at the end (the last point joins the first)."""
    return F.transform(F.concat(F.col(ring), F.slice(ring, 1, 1)), lambda p: p[axis])


def cover_polygons(shapes: DataFrame, shape_id: str, ring: str, target: float = 0.1) -> DataFrame:
    """The cover of polygons given as rings of points with x and y, whose last point joins the first; one task covers a share of the shapes.

    A null ring, or one of under three points or with a null or non-finite coordinate, covers nothing. target: the
    share of the covered area that may be left to the exact test.
    """
    flat = spread(polygons(shapes, shape_id, ring).select("shape_id", "form", "xs", "ys"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, form, xs, ys in zip(batch["shape_id"], batch["form"], batch["xs"], batch["ys"]):
                if xs is None or len(xs) < 4:
                    continue
                xs, ys = np.array(xs, dtype=float), np.array(ys, dtype=float)
                if np.isfinite(xs).all() and np.isfinite(ys).all():
                    rows = cover_of(sid, form, (xs.min(), ys.min(), xs.max(), ys.max()), _judge_polygon(xs, ys), target)
                    if rows is not None:
                        yield rows

    return flat.mapInPandas(cover, COVER)


def cover_discs(centres: DataFrame, shape_id: str, x: str, y: str, radius_m: float, target: float = 0.15) -> DataFrame:
    """The cover of the discs of radius_m around centres in degrees (x longitude, y latitude).

    Discs that cross the 180th meridian are covered on both of its sides. A centre with a
    null or non-finite coordinate, or a latitude beyond the poles, covers nothing. target as in cover_polygons.
    """
    flat = spread(discs(centres.where(F.col(x).between(-540, 540) & F.col(y).between(-90, 90)), shape_id, x, y, radius_m).select("shape_id", "form", "cx", "cy"))

    def cover(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for sid, form, cx, cy in zip(batch["shape_id"], batch["form"], batch["cx"], batch["cy"]):
                dy = np.degrees(radius_m / EARTH_M) * 1.02
                top = min(89.9999, abs(cy) + dy)
                dx = min(180.0, dy / np.cos(np.radians(top)))
                for shift in (-360.0, 0.0, 360.0):
                    x0 = cx + shift
                    if x0 + dx < -180.0 or x0 - dx > 180.0:
                        continue
                    rows = cover_of(sid, form, (x0 - dx, cy - dy, x0 + dx, cy + dy), _judge_disc(x0, cy, radius_m), target)
                    if rows is not None:
                        parts.append(rows)
            if parts:
                yield pd.concat(parts)

    return flat.mapInPandas(cover, COVER)


def cell_of(x: Column, y: Column, level: int, parts: int = 1) -> tuple[Column, Column, Column]:
    """(number of the cell of a level that holds a point, null where that is out of reach; column and row of the point among parts × parts of it)."""
    s = _side(level)
    place = lambda v: F.floor(v / F.lit(s / parts))
    column, row = place(x), place(y)
    packed = F.lit(int(_pack(level, np.array(-REACH), np.array(-REACH)))).bitwiseOR(F.shiftleft(F.floor(column / parts) + F.lit(REACH), 30)).bitwiseOR(F.floor(row / parts) + F.lit(REACH))
    limit = s * (REACH - 1)
    return F.when((F.abs(x) < limit) & (F.abs(y) < limit), packed), F.pmod(column, F.lit(parts)), F.pmod(row, F.lit(parts))


def inside_ring(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Exact test: an odd number of the ring's sides lies to the right of the point. Sides are straight in x and y."""
    steps = F.sequence(F.lit(0), F.size(xs) - 2)

    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = xs[i], ys[i], xs[i + 1], ys[i + 1]
        rise = F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1)
        return ((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / rise + x1)

    return F.aggregate(steps, F.lit(False), lambda odd, i: odd != crosses(i))


def metres(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Great-circle distance (haversine) of points in degrees."""
    h = F.pow(F.sin(F.radians(y2 - y1) / 2), 2) + F.cos(F.radians(y1)) * F.cos(F.radians(y2)) * F.pow(F.sin(F.radians(x2 - x1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def polygons(shapes: DataFrame, shape_id: str, ring: str) -> DataFrame:
    """What the exact test needs of each polygon: shape_id, form (a number of its outline), xs, ys, and cx, cy, radius (null)."""
    empty = F.lit(None).cast("double")
    rows = shapes.where(F.col(shape_id).isNotNull()).select(F.col(shape_id).cast("bigint").alias("shape_id"), closed(ring, "x").alias("xs"), closed(ring, "y").alias("ys"))
    return rows.select("shape_id", F.xxhash64("xs", "ys").alias("form"), "xs", "ys", empty.alias("cx"), empty.alias("cy"), empty.alias("radius"))


def discs(centres: DataFrame, shape_id: str, x: str, y: str, radius_m: float) -> DataFrame:
    """The same of each disc."""
    empty = F.lit(None).cast("array<double>")
    known = centres.where(F.col(shape_id).isNotNull())
    return known.select(F.col(shape_id).cast("bigint").alias("shape_id"), F.xxhash64(x, y).alias("form"), empty.alias("xs"), empty.alias("ys"), F.col(x).alias("cx"), F.col(y).alias("cy"), F.lit(float(radius_m)).alias("radius"))


def match_cover(points: DataFrame, x: str, y: str, cover: DataFrame, shapes: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The points joined with the shapes that hold them: all columns of points, keys, and shape_id (which take the place of columns of these names).

    cover and shapes share keys, if any, shape_id and form; a shape that occurs twice matches twice. Points look
    up their cell of each level that the cover uses (equi-join). Matches of inner cells, coarse or fine, are accepted;
    those of fine cells on the outline meet their shape and take the exact test. Cover and shapes are broadcast
    within BROADCAST_ROWS and BROADCAST_CORNERS, counted, else shuffled, where Spark splits cells and shapes
    that hold many points. Points with a null or NaN coordinate match nothing. A point in several
    shapes comes out once for each; repeated points come out as often as they occur.
    """
    on, out = [*keys, "shape_id", "form"], [*keys, "shape_id"]
    cover = written(cover, "cover")
    facts = cover.groupBy("level").agg(F.count(F.lit(1)).alias("rows")).collect()  # a handful of levels
    levels, rows = sorted(r["level"] for r in facts), sum(r["rows"] for r in facts)
    side = cover.select(*[F.col(c).alias(f"cover_{c}") for c in [*on, "cell", "filled", "edge"]])
    shapes = written(shapes.distinct(), "shapes")
    size = shapes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.greatest(F.size("xs"), F.lit(1))), F.lit(0)).alias("corners")).first()
    exact = shapes.select(*[F.col(c).alias(f"exact_{c}") for c in shapes.columns])
    if rows <= BROADCAST_ROWS:
        side = F.broadcast(side)
    if size["n"] <= BROADCAST_ROWS and size["corners"] <= BROADCAST_CORNERS:
        exact = F.broadcast(exact)
    known = points.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    cells = []
    for k in levels:
        cell, column, row = cell_of(F.col(x), F.col(y), k, FINE)
        cells.append(F.struct(cell.alias("cell"), (column * FINE + row).cast("int").alias("fine")))
    cells = F.array(*cells) if cells else F.array().cast("array<struct<cell:bigint,fine:int>>")
    found = known.withColumn("_at", F.explode(cells)).join(side, F.col("_at.cell") == F.col("cover_cell"))
    bit = lambda name: F.getbit(F.col(name)[F.shiftright("_at.fine", 6)], F.col("_at.fine").bitwiseAND(F.lit(63)))
    found = found.withColumn("_sure", F.col("cover_filled").isNull() | (bit("cover_filled") == 1)).where(F.col("_sure") | (bit("cover_edge") == 1))
    found = found.join(exact, [F.col(f"cover_{c}") == F.col(f"exact_{c}") for c in on])
    ring = inside_ring(F.col(x), F.col(y), F.col("exact_xs"), F.col("exact_ys"))
    disc = metres(F.col(x), F.col(y), F.col("exact_cx"), F.col("exact_cy")) <= F.col("exact_radius")
    found = found.where(F.col("_sure") | F.when(F.col("exact_radius").isNull(), ring).otherwise(disc))
    return found.select(*[F.col(f"`{c}`") for c in points.columns if c not in out], *[F.col(f"cover_{c}").alias(c) for c in out])


def edge_share(cover: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cells, edge_share: the share of the covered area that takes the exact test."""
    return cover.groupBy(*keys).agg(F.count(F.lit(1)).alias("cells"), (F.sum("share") / F.sum("area")).alias("edge_share"))
