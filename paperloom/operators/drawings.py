"""Checks of vector drawings (SVG text): forbidden constructs, fonts, sizes, drift from a design lock, annotations, templates.

Rules are a table of name, severity and a predicate over the drawing's text; all are evaluated in one narrow pass and the hits are exploded.
A caller adds rules of its own with :func:`rule_hits`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ERROR, WARNING = "error", "warning"
#: Constructs that a slide can't hold, as patterns of the lower-cased text.
FORBIDDEN = {
    "mask": "<mask",
    "style_element": "<style",
    "stylesheet_instruction": r"<\?xml-stylesheet\b",
    "stylesheet_link": r"<link[^>]*rel\s*=\s*[\"']stylesheet[\"']",
    "css_import": r"@import\s+",
    "foreign_object": "<foreignobject",
    "text_path": "<textpath",
    "font_face": "@font-face",
    "animate": "<animate",
    "set": r"<set\b",
    "script": "<script",
    "iframe": "<iframe",
    "rgba": r"rgba\s*\(",
    "group_opacity": r"<g[^>]*\sopacity\s*=",
    "image_opacity": r"<image[^>]*\sopacity\s*=",
}
#: The same, as patterns of the text as it is.
FORBIDDEN_CASED = {"class_attribute": r"\bclass\s*=", "event_attribute": r"\bon\w+\s*="}
#: Families that every machine has, which a stack of fonts must end with, and generic names that don't count.
SAFE_FONTS = (
    "microsoft yahei, simhei, simsun, kaiti, fangsong, pingfang sc, heiti sc, songti sc, stsong, arial, arial black, calibri, segoe ui, verdana, helvetica, helvetica neue, tahoma, "
    "trebuchet ms, times new roman, times, georgia, cambria, palatino, consolas, courier new, menlo, monaco, impact"
).split(", ")
GENERIC_FONTS = ["sans-serif", "serif", "monospace", "cursive", "fantasy", "system-ui"]
#: Names of the patterns that a slide can fill with.
PATTERN_FILLS = (
    "pct5 pct10 pct20 pct25 pct30 pct40 pct50 pct60 pct70 pct75 pct80 pct90 horz vert ltHorz ltVert dkHorz dkVert narHorz narVert dashHorz dashVert cross dnDiag upDiag ltDnDiag ltUpDiag "
    "dkDnDiag dkUpDiag wdDnDiag wdUpDiag dashDnDiag dashUpDiag diagCross smCheck lgCheck smGrid lgGrid dotGrid smConfetti lgConfetti horzBrick diagBrick solidDmnd openDmnd dotDmnd plaid "
    "sphere weave wave trellis zigZag divot shingle"
).split()
#: Sizes of text may be from so many times the body's to so many.
RAMP = (0.5, 5.0)
LONG_TEXT = 100
#: Fixed value: characters of an annotated text that are shown.
PREVIEW = 50


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag; empty if it isn't there."""
    both = F.regexp_extract(tag, f"[ \\t\\r\\n]{name}[ \\t]*=[ \\t]*(\"[^\"]*\"|'[^']*')", 1)
    return F.substring(both, F.lit(2), F.length(both) - 2)


def static_rules(svg: Column, expected_viewbox: Column | None = None) -> list[tuple[str, str, Column]]:
    """(rule, severity, predicate) of a drawing's text."""
    low = F.lower(svg)
    rules = [(name, ERROR, low.rlike(p)) for name, p in FORBIDDEN.items()] + [(name, ERROR, svg.rlike(p)) for name, p in FORBIDDEN_CASED.items()]
    rules.append(("id_with_style", ERROR, low.contains("<style") & svg.rlike(r"\bid\s*=")))
    rules.append(("symbol_with_use", ERROR, low.contains("<symbol") & low.rlike(r"<use\b")))
    # tags and their attributes are taken out once; the rules look at these
    tags = _all(svg, "(<[A-Za-z][^>]*>)")
    name = lambda tag: F.lower(F.regexp_extract(tag, "^<([A-Za-z][A-Za-z0-9_]*)", 1))
    marked = F.exists(tags, lambda tag: attribute(tag, "marker-start").startswith("url(#") | attribute(tag, "marker-end").startswith("url(#"))
    rules.append(("marker_without_definition", ERROR, marked & ~low.contains("<marker")))
    clipped, clip = F.filter(tags, lambda tag: attribute(tag, "clip-path") != ""), low.contains("<clippath")
    # images may be clipped, and a nested drawing that crops one
    rules.append(("clip_on_shape", ERROR, clip & F.exists(clipped, lambda tag: (name(tag) != "image") & ~((name(tag) == "svg") & (attribute(tag, "data-pptx-crop") == "1")))))
    wanted = F.filter(F.transform(clipped, lambda tag: F.regexp_extract(attribute(tag, "clip-path"), r"^url\(#(.+)\)$", 1)), lambda ref: ref != "")
    ids = F.transform(tags, lambda tag: attribute(tag, "id"))
    rules.append(("clip_without_definition", ERROR, clip & (F.size(F.array_except(wanted, ids)) > 0)))
    viewbox = F.coalesce(F.try_element_at(F.filter(F.transform(tags, lambda tag: attribute(tag, "viewBox")), lambda v: v != ""), F.lit(1)), F.lit(""))
    rules.append(("viewbox_missing", ERROR, viewbox == ""))
    sides = F.split(F.trim(viewbox), " +")
    rules.append(("viewbox_unusual", WARNING, (viewbox != "") & ~viewbox.rlike("^0 0 [0-9]+ [0-9]+")))
    if expected_viewbox is not None:
        rules.append(("viewbox_mismatch", ERROR, (viewbox != "") & expected_viewbox.isNotNull() & (viewbox != expected_viewbox)))
    side = lambda which: F.coalesce(F.try_element_at(F.filter(F.transform(tags, lambda tag: attribute(tag, which)), lambda v: v.rlike("^[0-9]+$")), F.lit(1)), F.lit(""))
    width, height = side("width"), side("height")
    differs = (width != F.try_element_at(sides, F.lit(3))) | (height != F.try_element_at(sides, F.lit(4)))
    rules.append(("size_mismatch", WARNING, (width != "") & (height != "") & (F.size(sides) == 4) & differs))
    rules.append(("long_text", WARNING, F.size(_all(svg, "<text[^>]*>([^<]{%d,})</text>" % LONG_TEXT)) > 0))
    rules.append(("unsafe_font", WARNING, F.exists(_all(svg, r"(?i)font-family[:\s=]*[\"']([^\"']+)[\"']"), _unsafe)))
    fills = F.transform(F.filter(tags, lambda tag: name(tag) == "pattern"), lambda tag: attribute(tag, "data-pptx-pattern"))
    rules.append(("pattern_unnamed", WARNING, F.array_contains(fills, "")))
    rules.append(("pattern_unknown", ERROR, F.exists(fills, lambda v: (v != "") & ~v.isin(PATTERN_FILLS))))
    return [(n, s, F.coalesce(p, F.lit(False))) for n, s, p in rules]


def _unsafe(stack: Column) -> Column:
    """Whether a stack's last concrete family is one that machines may lack."""
    parts = F.transform(F.split(stack, ","), lambda p: F.lower(F.regexp_replace(F.trim(p), "^[\"']+|[\"']+$", "")))
    named = F.filter(parts, lambda p: (p != "") & ~p.isin(GENERIC_FONTS))
    return (F.size(named) > 0) & ~F.element_at(named, -1).isin(SAFE_FONTS)


def rule_hits(drawings: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(key, rule, severity) for each rule that holds."""
    hits = F.array(*[F.when(p, F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in rules])
    return drawings.select(key, F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("h")).select(key, "h.rule", "h.severity")


#: What an issue is called in a summary.
CATEGORIES = {"viewbox_missing": "viewBox issues", "viewbox_unusual": "viewBox issues", "viewbox_mismatch": "viewBox issues", "foreign_object": "foreignObject", "font_face": "Font issues", "unsafe_font": "Font issues"}
OTHER = "Other"


def check_report(drawings: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """(kind, name, n, percent): the number of drawings (kind ``total``), of those by their worst finding (``result``: passed, warnings, errors), and of errors by category (``category``).

    One narrow pass makes an array of a drawing's findings; it is exploded once, and all numbers come from one aggregate over grouping sets. The percentage of drawings is cut to a whole number.
    """
    hits = F.filter(F.array(*[F.when(p, F.struct(F.lit(CATEGORIES.get(n, OTHER)).alias("category"), F.lit(s).alias("severity"))) for n, s, p in rules]), lambda h: h.isNotNull())
    rows = drawings.select(hits.alias("h"))
    errors = F.filter("h", lambda h: h["severity"] == ERROR)
    result = F.when(F.size(errors) > 0, "errors").when(F.size("h") > 0, "warnings").otherwise("passed")
    own = F.array(F.struct(result.alias("result"), F.lit(None).cast("string").alias("category")))
    each = rows.select(F.explode(F.concat(own, F.transform(errors, lambda h: F.struct(F.lit(None).cast("string").alias("result"), h["category"].alias("category"))))).alias("x")).select("x.result", "x.category")
    sets = each.groupingSets([[F.col("result")], [F.col("category")], []], "result", "category").agg(F.count("result").alias("drawings"), F.count("category").alias("issues"), F.grouping_id("result", "category").alias("of"))
    total = F.max(F.when(F.col("of") == 3, F.col("drawings"))).over(Window.partitionBy(F.lit(0)))  # a dozen rows
    kind = F.when(F.col("of") == 3, "total").when(F.col("of") == 1, "result").otherwise("category")
    n = F.when(kind == "category", F.col("issues")).otherwise(F.col("drawings"))
    out = sets.select(kind.alias("kind"), F.coalesce("result", "category", F.lit("drawings")).alias("name"), n.alias("n"), (F.col("of") == 3).alias("_all"), F.col("result").alias("_r"), F.col("category").alias("_c"), total.alias("_total"))
    out = out.where(F.col("_all") | F.col("_r").isNotNull() | F.col("_c").isNotNull())
    return out.select("kind", "name", "n", F.when((F.col("kind") != "category") & (F.col("_total") > 0), F.floor(F.col("n") * 100 / F.col("_total"))).cast("int").alias("percent"))


def check_summary(drawings: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """One row: total, passed (no error and no warning), with warnings only, with errors, and the whole percentages of these."""
    worst = hits.groupBy(key).agg(F.max(F.when(F.col("severity") == ERROR, 2).otherwise(1)).alias("_w"))
    rows = drawings.select(key).join(worst, key, "left")
    n = lambda v: F.sum(F.when(F.coalesce("_w", F.lit(0)) == v, 1).otherwise(0))
    out = rows.agg(F.count("*").alias("total"), F.coalesce(n(0), F.lit(0)).alias("passed"), F.coalesce(n(1), F.lit(0)).alias("warnings"), F.coalesce(n(2), F.lit(0)).alias("errors"))
    share = lambda c: F.when(F.col("total") > 0, F.floor(F.col(c) * 100 / F.col("total"))).otherwise(0).cast("int")
    return out.select("*", *(share(c).alias(f"{c}_percent") for c in ("passed", "warnings", "errors")))


def issue_categories(hits: DataFrame) -> DataFrame:
    """(rule, n): issues by rule, the commonest first."""
    return hits.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def size_number(size: Column) -> Column:
    """A size without its unit."""
    return F.regexp_replace(F.trim(size), "(?i)px$", "")


def lock_drift(drawings: DataFrame, key: str, svg: str, colors: list[str], fonts: list[str], sizes: list[str], body: float | None) -> DataFrame:
    """(kind, value, files): colours, font stacks and sizes that the design lock doesn't have, and in how many drawings.

    Without fonts or sizes in the lock these aren't judged; a size within the ramp around the body's is no drift.
    """
    text = F.col(svg)
    used = F.array_distinct(F.transform(F.concat(*[_all(text, rf"\b{a}\s*=\s*[\"'](#[0-9A-Fa-f]{{3,8}})[\"']") for a in ("fill", "stroke", "stop-color")]), F.upper))
    upper = [c.upper() for c in colors]
    bad = [("color", F.filter(used, lambda v: ~v.isin(upper) if upper else F.lit(True)))]
    if fonts:
        bad.append(("font", F.filter(F.array_distinct(F.transform(_all(text, r"font-family\s*=\s*[\"']([^\"']+)[\"']"), F.trim)), lambda v: ~v.isin(fonts))))
    if sizes:
        number = lambda v: F.try_to_number(v, F.lit("99999.999")).cast("double") / F.lit(float(body or 1))
        ramp = lambda v: F.coalesce(number(v).between(*RAMP), F.lit(False)) if body else F.lit(False)
        bad.append(("size", F.filter(F.array_distinct(F.transform(_all(text, r"font-size\s*=\s*[\"']([^\"']+)[\"']"), size_number)), lambda v: ~v.isin(sizes) & ~ramp(v))))
    named = lambda kind: lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value"))
    each = F.flatten(F.array(*[F.transform(v, named(kind)) for kind, v in bad]))
    return drawings.select(key, F.explode(each).alias("d")).groupBy("d.kind", "d.value").agg(F.countDistinct(key).alias("files"))


def annotations(drawings: DataFrame, key: str, svg: str) -> DataFrame:
    """(key, element_id, tag, annotation, preview) of the elements that are marked for editing."""
    marked = _all(F.col(svg), r"(?s)(<(?![?!/])[^>]*\bdata-edit-target\s*=\s*[\"']true[\"'][^>]*>[^<]*)")
    attribute = lambda name: F.regexp_extract("e", rf"\b{name}\s*=\s*[\"']([^\"']*)[\"']", 1)
    each = drawings.select(key, F.posexplode(marked).alias("n", "e"))
    tag = F.regexp_extract("e", r"^<(?:[\w.-]+:)?([\w.-]+)", 1)
    ident = F.regexp_extract("e", r"\sid\s*=\s*[\"']([^\"']*)[\"']", 1)
    preview = F.when(tag == "text", F.left(F.trim(F.regexp_extract("e", r"(?s)>([^<]*)$", 1)), F.lit(PREVIEW))).otherwise("")
    return each.select(key, "n", F.when(ident == "", "(no id)").otherwise(ident).alias("element_id"), tag.alias("tag"), attribute("data-edit-annotation").alias("annotation"), preview.alias("preview"))


def annotation_counts(stored: DataFrame, edited: DataFrame, key: str) -> DataFrame:
    """(key, n): of each drawing the larger of the numbers in the two versions, 0 where one has none."""
    counts = lambda d, c: d.groupBy(key).agg(F.count("*").alias(c))
    both = counts(stored, "a").join(counts(edited, "b"), key, "full_outer")
    return both.select(key, F.greatest(F.coalesce("a", F.lit(0)), F.coalesce("b", F.lit(0))).alias("n"))


def missing_placeholders(templates: DataFrame, contract: DataFrame, overrides: DataFrame, stem: str = "stem", svg: str = "svg") -> DataFrame:
    """(stem, placeholder) that a template should have by its contract and hasn't.

    ``contract`` and ``overrides``: (page, placeholders). A template's contract is the override of its own name, else that of its page type (a
    variant's letter left out: ``03a_content_two`` is ``03_content``), else the contract's of that; an empty one asks for nothing.
    """
    number, kind = F.regexp_extract(stem, "^([0-9]{2})[a-z]?_([a-z]+)", 1), F.regexp_extract(stem, "^([0-9]{2})[a-z]?_([a-z]+)", 2)
    rows = templates.select(stem, svg, F.when(number != "", F.concat_ws("_", number, kind)).alias("_page"))
    own = overrides.select(F.col("page").alias(stem), F.col("placeholders").alias("_a"))
    by_type = overrides.select(F.col("page").alias("_page"), F.col("placeholders").alias("_b"))
    usual = contract.select(F.col("page").alias("_page"), F.col("placeholders").alias("_c"))
    found = rows.join(own, stem, "left").join(by_type, "_page", "left").join(usual, "_page", "left")
    wanted = found.select(stem, svg, F.explode(F.coalesce("_a", "_b", "_c")).alias("placeholder"))
    return wanted.where(~F.col(svg).contains(F.col("placeholder"))).select(stem, "placeholder")


def without_credit(drawings: DataFrame, key: str, svg: str, assets: DataFrame) -> DataFrame:
    """(key, filename): images of the manifest that must be credited, stand in a drawing, and aren't credited in it.

    ``assets``: (filename, credit) of those that must be. Drawings meet assets by the file names that their images refer to.
    """
    refs = F.transform(_all(F.col(svg), r"<image\b[^>]*?\bhref\s*=\s*[\"'](?!data:)([^\"']+)[\"']"), lambda h: F.element_at(F.split(h, "/"), -1))
    used = drawings.select(key, svg, F.explode(F.array_distinct(refs)).alias("filename"))
    return used.join(assets, "filename").where(~F.col(svg).contains(F.col("credit"))).select(key, "filename")


def replaced(drawings: DataFrame, key: str, svg: str, pairs: dict[str, str]) -> DataFrame:
    """(key, svg, n): each text with old values replaced by new ones whatever their case, and the number of places. Nothing is written here: a caller writes all drawings, or, as a dry run, none."""
    text, n = F.col(svg), F.lit(0)
    for old, new in pairs.items():
        pattern = "(?i)" + "".join(f"[{c}]" if c not in "\\^[]" else "\\" + c for c in old) + "(?![0-9A-Za-z])"
        n = n + F.regexp_count(text, F.lit(pattern))
        text = F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
    return drawings.select(key, text.alias(svg), n.alias("n"))
