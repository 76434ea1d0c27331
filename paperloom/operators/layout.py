"""Chart and box geometry as expressions over series tables: (group, idx, label, value).

Totals and extremes are aggregates joined back (a series is short, but groups are many); offsets are
arithmetic on the index. An area is (x_min, y_min, x_max, y_max); y grows downwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Area = tuple[float, float, float, float]


def bars(series: DataFrame, group: str, area: Area, width: float = 50.0, gap_ratio: float = 0.3, low: float = 0.0, horizontal: bool = False) -> DataFrame:
    """index, x, y, width, height and label position of each bar; the value axis ends at 1.1 times the maximum."""
    x0, y0, x1, y1 = area
    ends = series.groupBy(group).agg(F.count("*").alias("_n"), (F.max("value") * 1.1).alias("_top"))
    rows = series.join(ends, group)
    gap = width * gap_ratio
    across = (y1 - y0) if horizontal else (x1 - x0)
    start = (y0 if horizontal else x0) + (F.lit(across) - (F.col("_n") * width + (F.col("_n") - 1) * gap)) / 2
    at = start + (F.col("idx") - 1) * (width + gap)
    share = F.when(F.col("_top") > low, (F.col("value") - low) / (F.col("_top") - low)).otherwise(0.0)
    long_ = share * ((x1 - x0) if horizontal else (y1 - y0))
    r = lambda c: F.round(c, 1)
    if horizontal:
        return rows.select(group, "idx", r(F.lit(x0)).alias("x"), r(at).alias("y"), r(long_).alias("width"), r(F.lit(width)).alias("height"), r(F.lit(x0 - 10)).alias("label_x"), r(at + width / 2).alias("label_y"))
    return rows.select(group, "idx", r(at).alias("x"), r(F.lit(y1) - long_).alias("y"), r(F.lit(width)).alias("width"), r(long_).alias("height"), r(at + width / 2).alias("label_x"), r(F.lit(y1 + 30)).alias("label_y"))


def slices(series: DataFrame, group: str, radius: float, cx: float, cy: float, start: float = -90.0, inner: float = 0.0) -> DataFrame:
    """percentage, angles, end points, path and label position of each slice of a pie, or of a donut with an inner radius; groups of zero total have none."""
    w = Window.partitionBy(group).orderBy("idx")
    rows = series.withColumn("_total", F.sum("value").over(Window.partitionBy(group))).where("_total != 0")
    before = F.coalesce(F.sum("value").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    a = F.lit(start) + before / F.col("_total") * 360
    b = a + F.col("value") / F.col("_total") * 360
    rows = rows.withColumn("_a", a).withColumn("_b", b)
    mid = F.radians((F.col("_a") + F.col("_b")) / 2)
    pt = lambda r, f, c: F.round(F.lit(float(r)) * f(F.radians(c)), 2)
    points = {"start_x": pt(radius, F.cos, F.col("_a")), "start_y": pt(radius, F.sin, F.col("_a")), "end_x": pt(radius, F.cos, F.col("_b")), "end_y": pt(radius, F.sin, F.col("_b"))}
    points |= {f"_i{n}": pt(inner, f, F.col(c)) for n, f, c in ((0, F.cos, "_a"), (1, F.sin, "_a"), (2, F.cos, "_b"), (3, F.sin, "_b"))}
    rows = rows.withColumns(points | {"large_arc": F.when(F.col("_b") - F.col("_a") > 180, 1).otherwise(0)})
    return rows.select(
        group, "idx", F.round(F.col("value") / F.col("_total") * 100, 1).alias("percentage"), F.round("_a", 1).alias("start_angle"), F.round("_b", 1).alias("end_angle"), "large_arc",
        "start_x", "start_y", "end_x", "end_y", slice_path(radius, inner).alias("path"), F.round(cx + radius * 0.7 * F.cos(mid), 1).alias("label_x"), F.round(cy + radius * 0.7 * F.sin(mid), 1).alias("label_y"),
    )


def slice_path(radius: float, inner: float = 0.0) -> Column:
    """A slice's outline as SVG text: from the centre, or along the inner circle and back, closed."""
    outer = f"A {radius},{radius} 0 %d,1 %.2f,%.2f"
    if not inner:
        return F.format_string(f"M 0,0 L %.2f,%.2f {outer} Z", "start_x", "start_y", "large_arc", "end_x", "end_y")
    return F.format_string(f"M %.2f,%.2f L %.2f,%.2f {outer} L %.2f,%.2f A {inner},{inner} 0 %d,0 %.2f,%.2f Z", "_i0", "_i1", "start_x", "start_y", "large_arc", "end_x", "end_y", "_i2", "_i3", "large_arc", "_i0", "_i1")


def radar(series: DataFrame, group: str, radius: float, cx: float, cy: float, start: float = -90.0) -> DataFrame:
    """Vertices by share of the largest value, at equal angles."""
    ends = series.groupBy(group).agg(F.count("*").alias("_n"), F.max("value").alias("_top"))
    rows = series.join(ends, group)
    angle = F.lit(start) + (F.col("idx") - 1) * (F.lit(360.0) / F.col("_n"))
    share = F.when(F.col("_top") > 0, F.col("value") / F.col("_top")).otherwise(0.0)
    x, y = radius * share * F.cos(F.radians(angle)), radius * share * F.sin(F.radians(angle))
    return rows.select(group, "idx", F.round(share * 100, 1).alias("percentage"), F.round(angle, 1).alias("angle"), F.round(x, 2).alias("x"), F.round(y, 2).alias("y"), F.round(cx + x, 2).alias("abs_x"), F.round(cy + y, 2).alias("abs_y"))


def to_axis(value: Column, low: Column, high: Column, start: float, end: float) -> Column:
    """A linear map of [low, high] to [start, end]; the start where low equals high."""
    return F.when(high == low, F.lit(start)).otherwise(start + (value - low) / (high - low) * (end - start))


def line_points(series: DataFrame, group: str, area: Area) -> DataFrame:
    """svg_x and svg_y of (x, value): x over its own range, values from 0 to 1.1 times the maximum."""
    x0, y0, x1, y1 = area
    ends = series.groupBy(group).agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"), (F.max("value") * 1.1).alias("_top"))
    rows = series.join(ends, group)
    return rows.select(group, "idx", F.round(to_axis(F.col("x"), F.col("_lo"), F.col("_hi"), x0, x1), 1).alias("svg_x"), F.round(to_axis(F.col("value"), F.lit(0.0), F.col("_top"), y1, y0), 1).alias("svg_y"))


def grid(grids: DataFrame, key: str, rows: str, cols: str, area: Area, padding: float = 20.0, gap: float = 20.0) -> DataFrame:
    """The cells of each grid, with their centres."""
    x0, y0, x1, y1 = area
    r, c = F.col(rows), F.col(cols)
    width, height = (F.lit(x1 - x0 - 2 * padding) - (c - 1) * gap) / c, (F.lit(y1 - y0 - 2 * padding) - (r - 1) * gap) / r
    cells = grids.withColumn("row", F.explode(F.sequence(F.lit(1), r))).withColumn("col", F.explode(F.sequence(F.lit(1), c)))
    x, y = x0 + padding + (F.col("col") - 1) * (width + gap), y0 + padding + (F.col("row") - 1) * (height + gap)
    r1 = lambda c: F.round(c, 1)
    return cells.select(key, "row", "col", ((F.col("row") - 1) * c + F.col("col")).alias("index"), r1(x).alias("x"), r1(y).alias("y"), r1(width).alias("width"), r1(height).alias("height"), r1(x + width / 2).alias("cx"), r1(y + height / 2).alias("cy"))


#: Fixed values, in EMU: margins, gap and the height of a title; columns of a grid.
MARGIN, GAP, TITLE_HEIGHT, COLUMNS = 457_200, 182_880, 914_400, 3


def arrange(images: DataFrame, group: str, slide_width: int, slide_height: int, margin: int = MARGIN, gap: int = GAP, title_height: int = TITLE_HEIGHT, columns: int = COLUMNS) -> DataFrame:
    """(group, idx, x, y, width, height): boxes of a slide's n images (idx from 1) under its title, in whole units: one alone, two side by side, one above two, or a grid of up to three columns."""
    rows = images.join(images.groupBy(group).agg(F.count("*").alias("_n")), group)
    n, i = F.col("_n"), F.col("idx") - 1
    cols = F.when(n <= 3, F.least(n, F.lit(2))).otherwise(F.least(n, F.lit(columns)))
    lines = F.ceil(n / cols)
    whole = lambda total, parts: F.floor((F.lit(total) - (parts - 1) * gap) / parts)
    usable_w, usable_h = slide_width - 2 * margin, slide_height - 2 * margin - title_height
    width, height = F.when((n == 3) & (i == 0), usable_w).otherwise(whole(usable_w, cols)), whole(usable_h, lines)
    # of three, the second and third are below the first
    col, row = F.when(n == 3, F.greatest(i - 1, F.lit(0))).otherwise(i % cols), F.when(n == 3, F.least(i, F.lit(1))).otherwise(F.floor(i / cols))
    place = lambda c: c.cast("long")
    return rows.select(group, "idx", place(margin + col * (whole(usable_w, cols) + gap)).alias("x"), place(title_height + margin + row * (height + gap)).alias("y"), place(width).alias("width"), place(height).alias("height"))


#: Fixed values, in pixels: between image and text, what a text needs at least, and the share of the width that an image gets where that isn't left.
TEXT_GAP, LEAST_TEXT_HEIGHT, LEAST_TEXT_WIDTH, IMAGE_SHARE = 20, 150, 280, 0.7


def text_beside_image(ratio: Column, width: int, height: int, gap: int = TEXT_GAP) -> dict[str, Column]:
    """layout, image_w, image_h, text_w, text_h in whole pixels: wide images on top if room for text is left below; others at the side in full height if it is left there; else at the side, narrower."""
    pixels = lambda c: F.bround(c).cast("int")
    top_h, side_w = pixels(width / ratio), pixels(height * ratio)
    on_top = (ratio > 1.5) & (height - top_h - gap >= LEAST_TEXT_HEIGHT)
    full = (ratio <= 1.5) & (width - side_w - gap >= LEAST_TEXT_WIDTH)
    narrow = round(width * IMAGE_SHARE)
    pick = lambda a, b, c: F.when(on_top, a).when(full, b).otherwise(c).cast("int")
    return {
        "layout": F.when(on_top, "top-bottom").otherwise("left-right"),
        "image_w": pick(width, side_w, narrow),
        "image_h": pick(top_h, height, F.least(pixels(F.lit(narrow) / ratio), F.lit(height))),
        "text_w": pick(width, width - side_w - gap, max(width - narrow - gap, LEAST_TEXT_WIDTH)),
        "text_h": pick(height - top_h - gap, height, height),
    }


def validate_positions(expected: DataFrame, found: DataFrame, keys: list[str], tolerance: float = 1.0) -> DataFrame:
    """(keys, ok): found within the tolerance; missing ones fail."""
    f = found.select(*keys, F.col("x").alias("_x"), F.col("y").alias("_y"))
    near = (F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance)
    return expected.join(f, keys, "left").select(*keys, F.coalesce(near, F.lit(False)).alias("ok"))
