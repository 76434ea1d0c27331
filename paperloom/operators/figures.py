"""Images and drawings of pages: which to keep, and which drawings a caption belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Limits for images that are worth keeping.
MIN_PIXELS, MIN_AREA, MIN_BYTES = 100, 30_000, 2048
MIN_PAGE_SHARE, MAX_ASPECT = 0.05, 12
LOW_BYTES_A_PIXEL, LOW_INFO_AREA = 0.08, 500_000
#: How far a drawing may be from its caption, what surrounds it, and the least figure.
CAPTION_GAP, CAPTION_REACH = 90, 380
BACKGROUND_COVER, BACKGROUND_AREA = 0.95, 1.9
FIGURE_WIDTH, FIGURE_HEIGHT, PADDING, CAPTION_SPACE = 100, 80, 10, 2
#: Fixed value: how a caption begins.
CAPTION = r"(?i)^(?:Figure|Fig\.|图)\s*[0-9]+[-.]?[0-9]*\s*[:.]?\s*"


def is_caption(text: Column) -> Column:
    return F.trim(text).rlike(CAPTION)


def kept_images(images: DataFrame, order: list[str], scope: str = "file") -> DataFrame:
    """``images`` with ``kept``: large enough in pixels and bytes, the first of its content in its file, large on its page, no bar and no plain colour.

    Columns: width and height in pixels, n_bytes, content_hash, x0, y0, x1, y1 and page_width, page_height. An image whose content has been met
    before is dropped even if the first of them was dropped for its place or shape.
    """
    area = F.col("width") * F.col("height")
    large = (F.col("width") >= MIN_PIXELS) & (F.col("height") >= MIN_PIXELS) & (area >= MIN_AREA) & (F.col("n_bytes") >= MIN_BYTES)
    marked = images.withColumn("_large", F.coalesce(large, F.lit(False)))
    # the first of equal contents, without a sort of them
    place = F.struct(*order)
    first = marked.where("_large").groupBy(scope, "content_hash").agg(F.min(place).alias("_first"))
    joined = marked.join(first, [scope, "content_hash"], "left")
    paged = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    tiny = paged & ((F.col("x1") - F.col("x0")) / F.col("page_width") < MIN_PAGE_SHARE) & ((F.col("y1") - F.col("y0")) / F.col("page_height") < MIN_PAGE_SHARE)
    bar = F.greatest("width", "height") / F.greatest(F.least("width", "height"), F.lit(1)) > MAX_ASPECT
    plain = (F.col("n_bytes") / area < LOW_BYTES_A_PIXEL) & (area < LOW_INFO_AREA)
    kept = F.col("_large") & (place == F.col("_first")) & ~tiny & ~bar & ~plain
    return joined.select(*images.columns, F.coalesce(kept, F.lit(False)).alias("kept"))


def captioned_figures(captions: DataFrame, drawings: DataFrame, backgrounds: DataFrame, page: str = "page", cell: float = 400.0) -> DataFrame:
    """(page, caption, x0, y0, x1, y1): what each caption is under.

    The union of the page's drawings that begin above the caption, end no more than ``CAPTION_REACH`` above it and are ``CAPTION_GAP``
    to its side at most; or the first background (by its ``rank``) that covers that and isn't much larger; with a
    margin, cut at the page and above the caption. All are rectangles x0, y0, x1, y1; pages' sizes are in captions as
    page_width and page_height. Drawings meet captions in bands of the page's height, not all with all.
    """
    box = lambda d, p: [F.col(c).cast("double").alias(p + c) for c in ("x0", "y0", "x1", "y1")]
    c = captions.select(page, "caption", "page_width", "page_height", *box(captions, "c"))
    # a drawing's end is within reach of the caption's top, or it crosses that: one of the bands that it touches is, or is next to, the caption's
    band = lambda y: F.floor(y / cell).cast("long")
    near = c.withColumn("_b", F.explode(F.array(band(F.col("cy0")) - 1, band(F.col("cy0")))))
    d = drawings.select(page, *box(drawings, "d")).withColumn("_b", F.explode(F.sequence(band(F.col("dy0")), band(F.col("dy1")))))
    gap = F.greatest(F.col("cx0") - F.col("dx1"), F.col("dx0") - F.col("cx1"), F.lit(0.0))
    related = near.join(d, [page, "_b"]).where((gap <= CAPTION_GAP) & (F.col("dy0") <= F.col("cy0")) & (F.col("cy0") - F.col("dy1") <= CAPTION_REACH))
    union = related.groupBy(page, "caption", "page_width", "page_height", "cy0").agg(F.min("dx0").alias("ux0"), F.min("dy0").alias("uy0"), F.max("dx1").alias("ux1"), F.max("dy1").alias("uy1"))
    clip = lambda col, top: F.greatest(F.lit(0.0), F.least(col, top))
    b = backgrounds.select(page, "rank", *box(backgrounds, "b"))
    both = union.join(b, page, "left")
    for x, top in (("bx0", "page_width"), ("bx1", "page_width"), ("by0", "page_height"), ("by1", "page_height")):
        both = both.withColumn(x, clip(F.col(x), F.col(top).cast("double")))
    size = (F.col("ux1") - F.col("ux0")) * (F.col("uy1") - F.col("uy0"))
    across = F.greatest(F.lit(0.0), F.least("ux1", "bx1") - F.greatest("ux0", "bx0")) * F.greatest(F.lit(0.0), F.least("uy1", "by1") - F.greatest("uy0", "by0"))
    fits = (size > 0) & (across >= BACKGROUND_COVER * size) & ((F.col("bx1") - F.col("bx0")) * (F.col("by1") - F.col("by0")) <= BACKGROUND_AREA * size)
    keys = [page, "caption", "page_width", "page_height", "cy0", "ux0", "uy0", "ux1", "uy1"]
    best = both.groupBy(*keys).agg(F.min(F.when(fits, F.struct("rank", "bx0", "by0", "bx1", "by1"))).alias("b"))
    corner = {x: F.coalesce(F.col(f"b.b{x}"), F.col(f"u{x}")) for x in ("x0", "y0", "x1", "y1")}
    out = best.select(
        page, "caption",
        F.greatest(F.lit(0.0), corner["x0"] - PADDING).alias("x0"), F.greatest(F.lit(0.0), corner["y0"] - PADDING).alias("y0"),
        F.least(F.col("page_width").cast("double"), corner["x1"] + PADDING).alias("x1"), F.least(F.col("page_height").cast("double"), corner["y1"] + PADDING, F.col("cy0") - CAPTION_SPACE).alias("y1"),
    )
    return out.where((F.col("x1") - F.col("x0") >= FIGURE_WIDTH) & (F.col("y1") - F.col("y0") >= FIGURE_HEIGHT))


def reading_order(boxes: DataFrame, group: str | list[str], order: list[str], top: str = "top", left: str = "left") -> DataFrame:
    """``boxes`` with ``position`` from 1 on: by top, then left, then the given order; missing places count as 0."""
    w = Window.partitionBy(group).orderBy(F.coalesce(F.col(top), F.lit(0)), F.coalesce(F.col(left), F.lit(0)), *order)
    return boxes.withColumn("position", F.row_number().over(w))
