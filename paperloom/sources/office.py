"""Office files as rows: shapes of slides, relationships, themes, sheets' cells, and documents as Markdown by their ending.

Zip parts are read in Arrow batches (``files.zip_parts``); what needs a parser of nested XML is a function from one part to rows, and all
that is relational (reading order, list inference, tables, hops over relationships) is expressions and joins over these.
"""

from __future__ import annotations

import json
import posixpath
import re
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import figures, grids
from ..operators.structure import html_to_markdown
from .files import zip_parts

#: Namespaces of the formats.
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
NO_CONTENT = "_No extractable text content._"

SHAPES = "path string, part string, n int, top long, left long, name string, kind string, paragraphs array<struct<level:int,text:string>>, cells array<array<string>>"


def _parsed(xml: str):
    try:
        return ElementTree.fromstring(xml)
    except ElementTree.ParseError:
        return None


def _plain(text: str) -> str:
    return " ".join(text.split())


def _paragraphs(body) -> list[tuple[int, str]]:
    out = []
    for p in body.iter(f"{A}p"):
        level = p.find(f"{A}pPr")
        text = "".join(x.text or "" if x.tag == f"{A}t" else "\n" for x in p.iter() if x.tag in (f"{A}t", f"{A}br"))
        out.append((int(level.get("lvl", 0)) if level is not None else 0, _plain(text)))
    return out


def _leaves(tree) -> list[dict]:
    """The shapes of a slide that aren't groups, groups taken apart at every depth."""
    out = []
    for shape in tree:
        kind = shape.tag.removeprefix(P)
        if kind == "grpSp":
            out += _leaves(shape)
        elif kind in ("sp", "pic", "graphicFrame", "cxnSp"):
            at, named = shape.find(f".//{A}off"), shape.find(f".//{P}cNvPr")
            off = at if at is not None else shape.find(f".//{P}xfrm/{A}off")
            table, body = shape.find(f".//{A}tbl"), shape.find(f"{P}txBody")
            cells = [[" ".join(x for _, x in _paragraphs(c) if x) for c in row.iter(f"{A}tc")] for row in table.iter(f"{A}tr")] if table is not None else []
            chart = kind == "graphicFrame" and table is None
            out.append({"top": int(off.get("y", 0)) if off is not None else 0, "left": int(off.get("x", 0)) if off is not None else 0, "name": named.get("name", "") if named is not None else "", "kind": "table" if cells else "picture" if kind == "pic" else "chart" if chart else "text", "paragraphs": _paragraphs(body) if body is not None else [], "cells": cells})
    return out


def slide_shapes(files: DataFrame, pattern: str = r"^ppt/slides/slide[0-9]+\.xml$") -> DataFrame:
    """A row for each shape of each slide, nested groups taken apart: its place, kind, paragraphs with their levels, cells of a table."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, part, xml in zip(pdf["path"], pdf["part"], pdf["xml"]):
                root = _parsed(xml)
                tree = root.find(f".//{P}spTree") if root is not None else None
                for n, s in enumerate(_leaves(tree) if tree is not None else []):
                    rows.append((path, part, n, s["top"], s["left"], s["name"], s["kind"], [{"level": a, "text": b} for a, b in s["paragraphs"]], s["cells"]))
            yield pd.DataFrame(rows, columns=["path", "part", "n", "top", "left", "name", "kind", "paragraphs", "cells"])

    return zip_parts(files, pattern).mapInPandas(run, SHAPES)


def frame_markdown(paragraphs: Column) -> Column:
    """A text frame: a list if any paragraph is indented or there are several, else the paragraph; empty ones don't count."""
    shown = F.filter(paragraphs, lambda p: F.trim(p["text"]) != "")
    listed = F.exists(shown, lambda p: p["level"] > 0) | (F.size(shown) > 1)
    items = F.transform(shown, lambda p: F.when(listed, F.concat(F.repeat(F.lit("  "), F.greatest(p["level"], F.lit(0))), F.lit("- "), p["text"])).otherwise(p["text"]))
    return F.array_join(items, "\n")


def cells_markdown(cells: Column) -> Column:
    """A table of cells, all rows as wide as the widest."""
    width = F.array_max(F.transform(cells, F.size))
    text = lambda c: F.when(F.trim(F.coalesce(c, F.lit(""))) == "", " ").otherwise(F.replace(F.trim(c), F.lit("|"), F.lit("\\|")))
    row = lambda r: grids.line_of(F.concat(F.transform(r, text), F.array_repeat(F.lit(" "), width - F.size(r))))
    lines = F.transform(cells, row)
    return F.array_join(F.concat(F.slice(lines, 1, 1), F.array(grids.line_of(F.array_repeat(F.lit("---"), width))), F.filter(lines, lambda x, i: i > 0)), "\n")


def slide_number(part: Column) -> Column:
    return F.regexp_extract(part, "([0-9]+)[.]xml", 1).cast("int")


def presentation_markdown(files: DataFrame) -> DataFrame:
    """(path, markdown): each presentation, slide after slide: its blocks in reading order, then its speaker notes."""
    parts = zip_parts(files, r"^ppt/slides/slide[0-9]+\.xml$").select("path", "part")
    shapes = figures.reading_order(slide_shapes(files), ["path", "part"], ["n"])
    frame = frame_markdown(F.col("paragraphs"))
    block = F.when(F.col("kind") == "table", cells_markdown(F.col("cells"))).when(F.col("kind") == "picture", F.concat(F.lit("> [Image] "), "name")).when(frame != "", frame).when(F.col("kind") == "chart", F.concat(F.lit("> [Chart] "), "name"))
    blocks = shapes.withColumn("block", block).where("block is not null and block != ''")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("position", c))), lambda x: x[c])
    by_slide = blocks.groupBy("path", "part").agg(F.array_join(ordered("block"), "\n\n").alias("body"))
    # a slide's notes by the relationship of the notes to it
    notes = slide_shapes(files, r"^ppt/notesSlides/notesSlide[0-9]+\.xml$").where(~F.col("name").rlike("(?i)slide (number|image)")).withColumn("t", frame_markdown(F.col("paragraphs"))).where("t != ''")
    notes = figures.reading_order(notes, ["path", "part"], ["n"]).groupBy("path", "part").agg(F.array_join(ordered("t"), "\n\n").alias("notes"))
    hop = targets(files).where("type = 'slide'").select("path", "part", F.col("target").alias("slide"))
    notes = notes.join(hop, ["path", "part"]).groupBy("path", F.col("slide").alias("part")).agg(F.min("notes").alias("notes"))
    slides = parts.join(by_slide, ["path", "part"], "left").join(notes, ["path", "part"], "left").withColumn("position", slide_number(F.col("part")))
    shown = F.row_number().over(Window.partitionBy("path").orderBy("position"))
    text = F.concat(F.lit("## Slide "), shown.cast("string"), F.lit("\n\n"), F.coalesce("body", F.lit(NO_CONTENT)), F.coalesce(F.concat(F.lit("\n\n### Speaker Notes\n\n"), "notes"), F.lit("")))
    return slides.withColumn("t", text).groupBy("path").agg(F.concat(F.array_join(ordered("t"), "\n\n"), F.lit("\n")).alias("markdown"))


def targets(files: DataFrame) -> DataFrame:
    """(path, part, id, type, target): relationships of every part, with whole target names and the last word of their type."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, part, xml in zip(pdf["path"], pdf["part"], pdf["xml"]):
                folder, name = posixpath.split(part)
                owner = posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels"))
                root = _parsed(xml)
                for n, rel in enumerate(root if root is not None else ()):
                    target = rel.get("Target", "")
                    inside = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(posixpath.dirname(owner), target))
                    rows.append((path, owner, n, rel.get("Id", ""), rel.get("Type", "").rpartition("/")[2], target if rel.get("TargetMode") == "External" else inside))
            yield pd.DataFrame(rows, columns=["path", "part", "n", "id", "type", "target"])

    return zip_parts(files, r"_rels/[^/]*\.rels$").mapInPandas(run, "path string, part string, n int, id string, type string, target string")


def slide_themes(files: DataFrame) -> DataFrame:
    """(path, slide, layout, master, theme): each slide's parts, three hops over the first relationships of their types; null where one ends."""
    every = targets(files)
    hop = lambda kind, a, b: every.where(F.col("type") == kind).groupBy("path", F.col("part").alias(a)).agg(F.min_by("target", "n").alias(b))
    slides = zip_parts(files, r"^ppt/slides/slide[0-9]+\.xml$").select("path", F.col("part").alias("slide"))
    out = slides.join(hop("slideLayout", "slide", "layout"), ["path", "slide"], "left")
    out = out.join(hop("slideMaster", "layout", "master"), ["path", "layout"], "left").join(hop("theme", "master", "theme"), ["path", "master"], "left")
    return out.select("path", "slide", "layout", "master", "theme")


def themes(files: DataFrame) -> DataFrame:
    """(path, part, colors map, fonts map) of each theme: colours by role, a system colour's as it was last; the Latin fonts of headings and text, the East Asian of text."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, part, xml in zip(pdf["path"], pdf["part"], pdf["xml"]):
                root = _parsed(xml)
                colors, fonts = {}, {}
                scheme = root.find(f".//{A}clrScheme") if root is not None else None
                for role in scheme if scheme is not None else ():
                    given, system = role.find(f"{A}srgbClr"), role.find(f"{A}sysClr")
                    value = given.get("val") if given is not None else system.get("lastClr") if system is not None else None
                    if value:
                        colors[role.tag.removeprefix(A)] = f"#{value}"
                for where, script, key in (("majorFont", "latin", "majorLatin"), ("minorFont", "latin", "minorLatin"), ("minorFont", "ea", "minorEastAsia")):
                    font = root.find(f".//{A}fontScheme/{A}{where}/{A}{script}") if root is not None else None
                    if font is not None and font.get("typeface"):
                        fonts[key] = font.get("typeface")
                rows.append((path, part, colors, fonts))
            yield pd.DataFrame(rows, columns=["path", "part", "colors", "fonts"])

    return zip_parts(files, r"^ppt/theme/theme[0-9]+\.xml$").mapInPandas(run, "path string, part string, colors map<string,string>, fonts map<string,string>")


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n


def sheet_parts(files: DataFrame) -> DataFrame:
    """(path, kind, sheet, row, col, value, row1, col1) of workbooks' visible sheets: kind ``cell``, or ``merged`` for a range."""
    wanted = r"^xl/(workbook\.xml|sharedStrings\.xml|_rels/workbook\.xml\.rels|worksheets/sheet[0-9]+\.xml)$"
    parts = zip_parts(files, wanted).groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("part", "xml"))).alias("parts"))

    def cells(path, parts):
        book, rels = _parsed(parts.get("xl/workbook.xml", "")), _parsed(parts.get("xl/_rels/workbook.xml.rels", ""))
        if book is None or rels is None:
            return
        strings = _parsed(parts["xl/sharedStrings.xml"]) if "xl/sharedStrings.xml" in parts else None
        shared = ["".join(t.text or "" for t in item.iter(f"{S}t")) for item in strings] if strings is not None else []
        place = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in rels}
        for sheet in book.iter(f"{S}sheet"):
            if sheet.get("state", "visible") != "visible":
                continue
            root = _parsed(parts.get("xl/" + place.get(sheet.get(f"{R}id"), ""), ""))
            for c in root.iter(f"{S}c") if root is not None else ():
                value, kind = c.find(f"{S}v"), c.get("t")
                text = shared[int(value.text)] if kind == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{S}t")) if kind == "inlineStr" else value.text if value is not None else None
                if text is not None:
                    yield path, "cell", sheet.get("name"), int(re.sub("[A-Z]+", "", c.get("r"))), _column(c.get("r")), text, None, None
            for m in root.iter(f"{S}mergeCell") if root is not None else ():
                a, b = m.get("ref").split(":")
                yield path, "merged", sheet.get("name"), int(re.sub("[A-Z]+", "", a)), _column(a), None, int(re.sub("[A-Z]+", "", b)), _column(b)

    def run(batches):
        for pdf in batches:
            rows = [x for path, found in zip(pdf["path"], pdf["parts"]) for x in cells(path, dict(found))]
            yield pd.DataFrame(rows, columns=["path", "kind", "sheet", "row", "col", "value", "row1", "col1"]).astype({"row1": "Int32", "col1": "Int32"})

    return parts.mapInPandas(run, "path string, kind string, sheet string, row int, col int, value string, row1 int, col1 int")


def workbook_markdown(files: DataFrame, max_rows: int = 0, max_cols: int = 0) -> DataFrame:
    """(path, sheet, markdown): a table for each visible sheet with content."""
    parts = sheet_parts(files).withColumn("key", F.struct("path", "sheet"))
    merged = parts.where("kind = 'merged'").select("key", F.col("row").alias("row0"), F.col("col").alias("col0"), "row1", "col1")
    rows = grids.rows_of(grids.filled(parts.where("kind = 'cell'"), merged, "key"), "key", max_rows, max_cols)
    return grids.markdown_tables(rows, "key").select("key.path", "key.sheet", "markdown")


def _document(xml: str) -> str:
    """A word-processing document: headings, lists, paragraphs and tables, in order."""
    root = _parsed(xml)
    body = root.find(f"{W}body") if root is not None else None
    out = []
    for node in body if body is not None else ():
        if node.tag == f"{W}tbl":
            rows = [[_plain("".join(t.text or "" for t in c.iter(f"{W}t"))).replace("|", "\\|") or " " for c in r.iter(f"{W}tc")] for r in node.iter(f"{W}tr")]
            width = max(map(len, rows), default=0)
            lines = [f"| {' | '.join(r + [' '] * (width - len(r)))} |" for r in rows]
            out.append("\n".join(lines[:1] + [f"| {' | '.join(['---'] * width)} |"] + lines[1:]))
        elif node.tag == f"{W}p":
            text, style = "".join(t.text or "" for t in node.iter(f"{W}t")).strip(), node.find(f"{W}pPr/{W}pStyle")
            level = re.fullmatch(r"(?i)heading ?([1-6])", style.get(f"{W}val", "") if style is not None else "")
            item = node.find(f"{W}pPr/{W}numPr/{W}ilvl")
            if text:
                out.append(f"{'#' * int(level[1])} {text}" if level else f"{'  ' * int(item.get(f'{W}val', 0))}- {text}" if item is not None else text)
    return "\n\n".join(out)


def _notebook(text: str) -> str:
    """A notebook: its prose, its code in fences, and the texts that this gave."""
    try:
        cells = json.loads(text).get("cells", [])
    except (ValueError, AttributeError):
        return ""
    joined = lambda x: "".join(x) if isinstance(x, list) else x or ""
    out = []
    for c in cells:
        source = joined(c.get("source")).strip("\n")
        if c.get("cell_type") == "markdown" and source:
            out.append(source)
        elif c.get("cell_type") == "code" and source:
            out.append(f"```python\n{source}\n```")
            for o in c.get("outputs", []):
                shown = joined(o.get("text") or o.get("data", {}).get("text/plain")).rstrip("\n")
                if shown:
                    out.append(f"```\n{shown}\n```")
    return "\n\n".join(out)


#: Which converter a file's ending goes to; a caller may add its own.
CONVERTERS = {"docx": "document", "html": "web", "htm": "web", "ipynb": "notebook", "md": "text", "txt": "text", "pptx": "slides", "xlsx": "workbook", "epub": "book"}


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, "[.]([A-Za-z0-9]+)$", 1))


def markdown(files: DataFrame) -> DataFrame:
    """(path, converter, markdown): each file by the converter of its ending; ``skipped`` and null where none is known.

    Files are (path, content). A book (EPUB) is its pages in the order of their names; sheets of a workbook follow each other under their names.
    """
    kind = F.lit("skipped")
    for end, name in CONVERTERS.items():
        kind = F.when(ending(F.col("path")) == end, name).otherwise(kind)
    routed = files.withColumn("converter", kind)
    of = lambda name: routed.where(F.col("converter") == name)

    def converted(df: DataFrame, column: str, convert) -> DataFrame:
        def run(batches):
            for pdf in batches:
                yield pd.DataFrame({"path": pdf["path"], "markdown": pdf[column].map(convert)})

        return df.select("path", column).mapInPandas(run, "path string, markdown string")

    text = F.decode("content", "UTF-8")
    plain = lambda name: of(name).select("path", text.alias("t"))
    pages = zip_parts(of("book"), r"\.x?html?$").select("path", "part", F.col("xml").alias("t"))
    name = F.split("key", "\n")
    book = html_to_markdown(pages.withColumn("key", F.concat_ws("\n", "path", "part")), "key", "t").select(name[0].alias("path"), name[1].alias("part"), "markdown")
    book = book.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "markdown"))), lambda x: x["markdown"]), "\n\n").alias("markdown"))
    sheets = workbook_markdown(of("workbook"))
    sheets = sheets.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sheet", "markdown"))), lambda x: F.concat(F.lit("## "), x["sheet"], F.lit("\n\n"), x["markdown"])), "\n\n").alias("markdown"))
    found = [
        converted(zip_parts(of("document"), r"^word/document\.xml$"), "xml", _document), html_to_markdown(plain("web"), "path", "t").select("path", "markdown"), converted(plain("notebook"), "t", _notebook),
        plain("text").select("path", F.col("t").alias("markdown")), presentation_markdown(of("slides")), book, sheets,
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return routed.select("path", "converter").join(out, "path", "left")


def import_summary(imported: DataFrame) -> DataFrame:
    """(outcome, files): how many files were turned to Markdown, had nothing in them, or were skipped."""
    outcome = F.when(F.col("converter") == "skipped", "skipped").when(F.coalesce(F.trim("markdown"), F.lit("")) == "", "empty").otherwise("markdown")
    return imported.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("files"))


def file_stats(files: DataFrame) -> DataFrame:
    """(suffix, files, bytes) of a project's files."""
    return files.groupBy(ending(F.col("path")).alias("suffix")).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"))
