"""Joins of rectangles and points in two dimensions, by a grid of levels.

A rectangle (x0, y0, x1, y1) has the level whose cells are as wide as its longer side: it touches four of these cells at most, whatever its size. A long and thin one has finer
cells, ``THIN`` times its shorter side wide or a ``PIECES``th of its longer one, so that it doesn't meet all that lies beside it. Two
rectangles meet in the cells of the coarser one's level; each pair is reported by one cell, that of the lower left corner of what they share. So it is an
equi-join on (page, level, cell) without duplicates, and a page of many boxes is as many keys as it has cells. Bounds are inclusive: rectangles that touch meet.

Points have no size, so for them the grids are chosen by the regions: a few, mostly one, and a point isn't repeated for each level.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIDES = ("x0", "y0", "x1", "y1")
#: From which ratio of its sides on a rectangle is long and thin, and how many cells it is cut into at most, along its longer side.
THIN, PIECES = 8, 64
#: Points in regions: grids at most, bytes of regions' pieces that are broadcast at most, bits of how many regions one array has, and what a piece, and a point's row that stays or moves, cost beside a comparison.
MOST_GRIDS, BROADCAST, CHUNK, PIECE, POINT, MOVED = 4, 256 << 20, 20, 100, 30, 150
#: A slide's size, and the regions (x0, x1, y0, y1) of the usual layouts.
SLIDE_WIDTH, SLIDE_HEIGHT = 12_192_000, 6_858_000
LAYOUTS = {
    "left_right": {"left": (0, 8_000_000, 0, SLIDE_HEIGHT), "right": (8_000_000, SLIDE_WIDTH, 0, SLIDE_HEIGHT)},
    "left_center_right": {"left": (0, 4_000_000, 0, SLIDE_HEIGHT), "center": (4_000_000, 9_000_000, 0, SLIDE_HEIGHT), "right": (9_000_000, SLIDE_WIDTH, 0, SLIDE_HEIGHT)},
    "top_bottom": {"top": (0, SLIDE_WIDTH, 0, 3_500_000), "bottom": (0, SLIDE_WIDTH, 3_500_000, SLIDE_HEIGHT)},
    "top_middle_bottom": {"top": (0, SLIDE_WIDTH, 0, 2_200_000), "middle": (0, SLIDE_WIDTH, 2_200_000, 4_600_000), "bottom": (0, SLIDE_WIDTH, 4_600_000, SLIDE_HEIGHT)},
}


def _levelled(rects: DataFrame, page: str, side: str, least: float) -> DataFrame:
    named = rects.select(F.col(page).alias(page), *(F.col(c).cast("double").alias(side + c) for c in SIDES), F.struct(*[c for c in rects.columns if c != page]).alias(side))
    wide, high = F.col(side + "x1") - F.col(side + "x0"), F.col(side + "y1") - F.col(side + "y0")
    longer = F.greatest(wide, high)
    size = F.least(longer, F.greatest(THIN * F.least(wide, high), longer / PIECES))
    level = F.when(size <= least, 0).otherwise(F.ceil(F.log2(size / least))).cast("int")
    return named.where((F.col(side + "x0") <= F.col(side + "x1")) & (F.col(side + "y0") <= F.col(side + "y1"))).withColumn(side + "level", level)


def _in_cells(rects: DataFrame, side: str, levels: list[int], least: float) -> DataFrame:
    """A row for each cell of the rectangle's own level, and of each coarser one that the other side has."""
    coarser = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x > F.col(side + "level"))
    rows = rects.withColumn("level", F.explode(F.concat(F.array(side + "level"), coarser))).withColumn("_c", F.lit(float(least)) * F.pow(F.lit(2.0), F.col("level")))
    cells = lambda d: F.sequence(F.floor(F.col(f"{side}{d}0") / F.col("_c")), F.floor(F.col(f"{side}{d}1") / F.col("_c")))
    return rows.withColumn("cx", F.explode(cells("x"))).withColumn("cy", F.explode(cells("y"))).drop("_c")


def meeting(left: DataFrame, right: DataFrame, page: str, least: float = 1.0) -> DataFrame:
    """(page, a, b): the rectangles of a page that meet, each pair once; a and b are structs of their sides' other columns.

    ``least`` is the side of the finest cells. Rectangles with a null, or whose ends are the wrong way round, meet nothing; rows without a page neither.
    """
    a, b = _levelled(left, page, "a", least), _levelled(right, page, "b", least)
    # as many as there are powers of two between the sizes
    levels = lambda d, side: sorted(r[0] for r in d.select(side + "level").distinct().collect())
    ca, cb = _in_cells(a, "a", levels(b, "b"), least), _in_cells(b, "b", levels(a, "a"), least)
    both = ca.join(cb, [page, "level", "cx", "cy"]).where(F.greatest("alevel", "blevel") == F.col("level"))
    meet = (F.col("ax0") <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1")) & (F.col("ay0") <= F.col("by1")) & (F.col("by0") <= F.col("ay1"))
    side = F.lit(float(least)) * F.pow(F.lit(2.0), F.col("level"))
    own = (F.floor(F.greatest("ax0", "bx0") / side) == F.col("cx")) & (F.floor(F.greatest("ay0", "by0") / side) == F.col("cy"))
    return both.where(meet & own).select(page, "a", "b")


def overlap(a: str = "a", b: str = "b") -> Column:
    """The area that the two share."""
    across = lambda d: F.greatest(F.lit(0.0), F.least(F.col(f"{a}.{d}1"), F.col(f"{b}.{d}1")) - F.greatest(F.col(f"{a}.{d}0"), F.col(f"{b}.{d}0")))
    return across("x") * across("y")


def _grids(found: list, points: int, pages: int, ends: list[tuple[float, float]], least: float, width: int) -> tuple[list[tuple[float, float]], dict[tuple[int, int], int], bool]:
    """Cells (wide, high) of a few grids, the grid of each class of sizes, and whether the pieces are few enough to be broadcast.

    ``found`` has (class across, class down, regions, mean width, mean height); costs suppose points that lie evenly, so they touch time only.
    """
    area = [max(high - low, least) for low, high in ends]
    tops = [max(0, math.ceil(math.log2(a / least))) for a in area]
    steps = [[least * 2.0**k for k in range(max(0, top - 28), top + 1)] for top in tops]
    cells = [(w, h) for w in steps[0] for h in steps[1]]
    cw, ch = (np.array(c)[:, None] for c in zip(*cells, strict=True))
    n, w, h = (np.array([float(r[k]) for r in found])[None, :] for k in (2, 3, 4))
    pieces = n * (w / cw + 1) * (h / ch + 1)
    met = n * points / max(pages, 1) * np.minimum(1, (w + cw) / area[0]) * np.minimum(1, (h + ch) / area[1])

    def chosen(piece: float, point: float) -> tuple[float, list[int], np.ndarray]:
        cost, own, best, least_cost = met + piece * pieces, [], math.inf, np.full((1, n.shape[1]), math.inf)
        while len(own) < MOST_GRIDS:
            sums = np.minimum(cost, least_cost).sum(axis=1) + points * point * (len(own) + 1)
            k = int(sums.argmin())
            if sums[k] > 0.95 * best:
                break
            own, best, least_cost = [*own, k], float(sums[k]), np.minimum(cost[k : k + 1], least_cost)
        of = np.array(own)[cost[own].argmin(axis=0)]
        made, seen = pieces[of, np.arange(len(of))].sum(), met[of, np.arange(len(of))].sum()
        sent = made * width <= BROADCAST
        return float(seen + PIECE * made + points * len(own) * (POINT if sent else MOVED)), own, of, sent

    _, own, of, sent = min((chosen(PIECE * 4.0**k, point) for k in range(6) for point in (POINT, MOVED)), key=lambda c: c[0])
    return [cells[k] for k in own], {(r[0], r[1]): own.index(int(k)) for r, k in zip(found, of, strict=True)}, sent


def in_regions(points: DataFrame, regions: DataFrame, page: str, x: str, y: str, least: float = 1.0) -> DataFrame:
    """Each point with each region (x0, x1, y0, y1) of its page that holds it, bounds included; a null bound is none. Columns of both, the page's once.

    Cells of a few grids, no finer than ``least``, fit the sizes of the regions, not the points: a point is in one cell of each grid, a region in cells of one, so a pair is met once.
    If the pieces of regions are few, they are broadcast and points stay where they are.
    """
    at = {"x": F.col(x).cast("double"), "y": F.col(y).cast("double")}
    finite = lambda c: F.when(F.abs(c) < math.inf, c)
    rows = points.where(F.col(page).isNotNull() & at["x"].isNotNull() & at["y"].isNotNull())
    total, odd, *found = rows.agg(F.count("*"), F.count_if(finite(at["x"]).isNull() | finite(at["y"]).isNull()), *(f(finite(c)) for c in at.values() for f in (F.min, F.max))).first()
    ends = {d: (found[k] or 0.0, found[k + 1] or 0.0) for d, k in (("x", 0), ("y", 2))}
    clipped = lambda c, d: F.least(F.greatest(c, F.lit(ends[d][0])), F.lit(ends[d][1]))
    own, others = [c for c in points.columns if c != page], [c for c in regions.columns if c not in (page, *SIDES, *points.columns)]
    # NaN is over all numbers
    open_ends = {"0": -math.inf, "1": math.nan}
    sides = regions.select(page, *others, *(F.coalesce(F.col(c).cast("double"), F.lit(open_ends[c[1]])).alias("_" + c) for c in SIDES))
    sides = sides.where(F.col(page).isNotNull() & (F.col("_x0") <= F.col("_x1")) & (F.col("_y0") <= F.col("_y1")))
    if not odd:
        sides = sides.where(" and ".join(f"_{d}0 <= double('{high!r}') and _{d}1 >= double('{low!r}')" for d, (low, high) in ends.items()))
    size = {d: clipped(F.col(f"_{d}1"), d) - clipped(F.col(f"_{d}0"), d) for d in "xy"}
    sized = sides.withColumns({f"_{d}c": F.when(size[d] <= least, 0).otherwise(F.floor(F.log2(size[d] / least))).cast("int") for d in "xy"})
    # columns of nested types are not measured, and not broadcast
    narrow = (T.NumericType, T.DatetimeType, T.BooleanType)
    bytes_of = [F.avg(F.octet_length(f.name)) if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(8.0 if isinstance(f.dataType, narrow) else math.inf) for f in sides.schema]
    classes = sized.groupBy("_xc", "_yc").agg(F.count("*").alias("n"), *(F.avg(c) for c in size.values())).collect()
    if not classes:
        classes = [(0, 0, 0, 0.0, 0.0)]
    pages, *widths = sides.agg(F.approx_count_distinct(page), *bytes_of).first()
    grids, grid_of, sent = _grids(classes, total, pages, list(ends.values()), least, 24 + sum(w or 0.0 for w in widths))
    many = max(yc for _, yc in grid_of) + 1
    numbers = F.array(*[F.lit(grid_of.get(divmod(k, many), 0)) for k in range((max(xc for xc, _ in grid_of) + 1) * many)])
    cell = lambda c, d, wide: F.floor((clipped(c, d) - F.lit(ends[d][0])) / wide)
    number = lambda k, cx, cy: F.shiftleft(k.cast("long"), 60).bitwiseOR(F.shiftleft(cx, 30)).bitwiseOR(cy)
    pieces = sized.withColumns({"_g": F.get(numbers, F.col("_xc") * many + F.col("_yc")), "_part": F.shiftright(F.monotonically_increasing_id(), CHUNK)})
    for k, d in enumerate("xy"):
        wide = F.get(F.array(*[F.lit(g[k]) for g in grids]), F.col("_g"))
        pieces = pieces.withColumn(f"_{d}c", F.explode(F.sequence(cell(F.col(f"_{d}0"), d, wide), cell(F.col(f"_{d}1"), d, wide))))
    # a cell's regions lie beside each other, in arrays of so many regions of a task at most
    pieces = pieces.groupBy(page, number(F.col("_g"), F.col("_xc"), F.col("_yc")).alias("_cell"), "_part").agg(F.collect_list(F.struct(*("_" + c for c in SIDES), *others)).alias("_in")).drop("_part")
    cells = [number(F.lit(k), cell(at["x"], "x", g[0]), cell(at["y"], "y", g[1])) for k, g in enumerate(grids)]
    placed = rows.select(page, *own, *(at[d].alias("_" + d) for d in "xy"), (F.explode(F.array(*cells)) if len(cells) > 1 else cells[0]).alias("_cell"))
    both = placed.join(F.broadcast(pieces) if sent else pieces, [page, "_cell"]).withColumn("_r", F.explode("_in"))
    held = F.col("_x").between(F.col("_r._x0"), F.col("_r._x1")) & F.col("_y").between(F.col("_r._y0"), F.col("_r._y1"))
    return both.where(held).select(page, *own, *(F.col(f"_r.{c}").alias(c) for c in others))


def uncovered(blocks: DataFrame, covers: DataFrame, page: str, share: float = 0.6, least: float = 1.0) -> DataFrame:
    """The blocks that no cover of their page has more than ``share`` of the area of. Blocks with the same sides have the same fate; those with a null side stay."""
    sides = blocks.select(page, *SIDES).distinct()
    area = (F.col("a.x1") - F.col("a.x0")) * (F.col("a.y1") - F.col("a.y0"))
    hidden = meeting(sides, covers.select(page, *SIDES), page, least).where(overlap() > share * area).select(page, *(F.col(f"a.{c}").alias(c) for c in SIDES)).distinct()
    return blocks.join(hidden, [page, *SIDES], "left_anti")
