"""Office sources, sheets, figures, drawings and registries on small files made here."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.operators import drawings, figures, gates, grids, registry
from paperloom.sources import office

NS = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def shape(x, y, *paragraphs, name="Box"):
    body = "".join(f'<a:p><a:pPr lvl="{lvl}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for lvl, t in paragraphs)
    return f'<p:sp><p:nvSpPr><p:cNvPr id="1" name="{name}"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="{x}" y="{y}"/></a:xfrm></p:spPr><p:txBody>{body}</p:txBody></p:sp>'


def slide(*shapes):
    return f'<p:sld {NS}><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'


def rels(*links):
    return "<Relationships>" + "".join(f'<Relationship Id="rId{n}" Type="{REL}/{kind}" Target="{target}"/>' for n, (kind, target) in enumerate(links, 1)) + "</Relationships>"


TABLE = '<p:graphicFrame><p:nvGraphicFramePr><p:cNvPr id="9" name="T"/></p:nvGraphicFramePr><p:xfrm><a:off x="0" y="500"/></p:xfrm><a:graphic><a:graphicData><a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>a|b</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>c</a:t></a:r></a:p></a:txBody></a:tc></a:tr><a:tr><a:tc><a:txBody><a:p><a:r><a:t>1</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl></a:graphicData></a:graphic></p:graphicFrame>'
DECK = zipped(
    {
        "ppt/slides/slide1.xml": slide(shape(0, 300, (0, "third"), (1, "deeper")), f"<p:grpSp><p:grpSp>{shape(50, 100, (0, 'second'))}</p:grpSp>{shape(5, 100, (0, 'first'))}</p:grpSp>", TABLE),
        "ppt/slides/slide2.xml": slide('<p:pic><p:nvPicPr><p:cNvPr id="2" name="Photo"/></p:nvPicPr></p:pic>', shape(0, 0, (0, " "))),
        "ppt/slides/slide10.xml": slide(),
        "ppt/notesSlides/notesSlide1.xml": slide(shape(0, 0, (0, "say this"))),
        "ppt/notesSlides/_rels/notesSlide1.xml.rels": rels(("slide", "../slides/slide2.xml")),
        "ppt/slides/_rels/slide1.xml.rels": rels(("image", "../media/i.png"), ("slideLayout", "../slideLayouts/slideLayout1.xml"), ("slideLayout", "../slideLayouts/other.xml")),
        "ppt/slideLayouts/_rels/slideLayout1.xml.rels": rels(("slideMaster", "../slideMasters/slideMaster1.xml")),
        "ppt/slideMasters/_rels/slideMaster1.xml.rels": rels(("theme", "/ppt/theme/theme1.xml")),
        "ppt/theme/theme1.xml": f'<a:theme {NS}><a:themeElements><a:clrScheme name="x"><a:dk1><a:sysClr val="windowText" lastClr="000000"/></a:dk1><a:accent1><a:srgbClr val="FF8800"/></a:accent1></a:clrScheme><a:fontScheme name="x"><a:majorFont><a:latin typeface="Georgia"/></a:majorFont><a:minorFont><a:latin typeface="Arial"/><a:ea typeface="SimSun"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>',
    }
)
SS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
BOOK = zipped(
    {
        "xl/workbook.xml": f'<workbook xmlns="{SS}" xmlns:r="{REL}"><sheets><sheet name="Data" r:id="rId1"/><sheet name="Secret" state="hidden" r:id="rId2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": rels(("worksheet", "worksheets/sheet1.xml"), ("worksheet", "worksheets/sheet2.xml")),
        "xl/sharedStrings.xml": f'<sst xmlns="{SS}"><si><t>Name</t></si><si><r><t>Pri</t></r><r><t>ce</t></r></si></sst>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{SS}"><sheetData><row><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row><row><c r="B3" t="inlineStr"><is><t>tea</t></is></c><c r="C3"><v>1.5</v></c></row><row><c r="C4"><v>-2</v></c></row></sheetData><mergeCells><mergeCell ref="B3:B4"/></mergeCells></worksheet>',
        "xl/worksheets/sheet2.xml": f'<worksheet xmlns="{SS}"><sheetData><row><c r="A1"><v>9</v></c></row></sheetData></worksheet>',
    }
)
WN = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f'<w:document {WN}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>plain</w:t></w:r></w:p><w:p><w:pPr><w:numPr><w:ilvl w:val="1"/></w:numPr></w:pPr><w:r><w:t>item</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>h</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
NOTEBOOK = json.dumps({"cells": [{"cell_type": "markdown", "source": ["# N\n", "text"]}, {"cell_type": "code", "source": "1+1", "outputs": [{"data": {"text/plain": ["2"]}}]}]}).encode()
EPUB = zipped({"OEBPS/b.xhtml": "<html><body><p>Two two two two.</p></body></html>", "OEBPS/a.xhtml": "<html><body><h1>One</h1></body></html>"})


@pytest.fixture(scope="module")
def files(spark):
    rows = [("d/a.pptx", DECK), ("d/b.xlsx", BOOK), ("d/c.docx", DOCX), ("d/n.ipynb", NOTEBOOK), ("d/e.epub", EPUB), ("d/m.md", b"# hi"), ("d/x.bin", b"?"), ("d/broken.pptx", b"no zip"), ("d/empty.docx", zipped({"word/document.xml": "<broken"}))]
    return spark.createDataFrame(rows, "path string, content binary").repartition(3)


def test_presentations(files):
    deck = files.where("path = 'd/a.pptx'")
    order = figures.reading_order(office.slide_shapes(deck), ["path", "part"], ["n"]).where("part like '%slide1.xml'").orderBy("position").collect()
    assert [r.paragraphs[0].text if r.paragraphs else r.kind for r in order] == ["first", "second", "third", "table"]
    assert office.presentation_markdown(deck).first().markdown == "## Slide 1\n\nfirst\n\nsecond\n\n- third\n  - deeper\n\n| a\\|b | c |\n| --- | --- |\n| 1 |   |\n\n## Slide 2\n\n> [Image] Photo\n\n### Speaker Notes\n\nsay this\n\n## Slide 3\n\n_No extractable text content._\n"
    hops = {r.slide[-11:]: r[2:] for r in office.slide_themes(deck).collect()}
    assert hops["slide1.xml"[-11:]] if "slide1.xml" in hops else hops["/slide1.xml"] == ("ppt/slideLayouts/slideLayout1.xml", "ppt/slideMasters/slideMaster1.xml", "ppt/theme/theme1.xml")
    assert hops["/slide2.xml"] == (None, None, None)
    theme = office.themes(deck).first()
    assert theme.colors == {"dk1": "#000000", "accent1": "#FF8800"} and theme.fonts == {"majorLatin": "Georgia", "minorLatin": "Arial", "minorEastAsia": "SimSun"}


def test_workbooks_and_dispatch(files):
    assert [tuple(r) for r in office.workbook_markdown(files.where("path like '%.xlsx'")).collect()] == [("d/b.xlsx", "Data", "| Name | Price |\n| --- | ---: |\n| tea | 1.5 |\n| tea | -2 |")]
    got = {r.path[2:]: (r.converter, r.markdown) for r in office.markdown(files).collect()}
    assert got["c.docx"] == ("document", "## Title\n\nplain\n\n  - item\n\n| h |\n| --- |") and got["m.md"] == ("text", "# hi") and got["x.bin"] == ("skipped", None)
    assert got["n.ipynb"][1] == "# N\ntext\n\n```python\n1+1\n```\n\n```\n2\n```" and got["b.xlsx"][1].startswith("## Data\n\n| Name")
    assert got["a.pptx"][1].startswith("## Slide 1") and got["broken.pptx"][1] is None and "One" in got["e.epub"][1] and got["e.epub"][1].index("One") < got["e.epub"][1].index("Two")
    assert {r.outcome: r.files for r in office.import_summary(office.markdown(files)).collect()} == {"markdown": 6, "skipped": 1, "empty": 2}
    assert {r.suffix: r.files for r in office.file_stats(files).collect()} == {"pptx": 2, "xlsx": 1, "docx": 2, "ipynb": 1, "epub": 1, "md": 1, "bin": 1}


def test_grids(spark):
    cells = spark.createDataFrame([("s", 3, 2, "x"), ("s", 3, 4, " "), ("s", 5, 3, "7"), ("t", 1, 1, "only")], "sheet string, row int, col int, value string")
    rows = {(r.sheet, r.row): r.cells for r in grids.rows_of(grids.filled(cells)).collect()}
    assert rows == {("s", 3): ["x", ""], ("s", 4): ["", ""], ("s", 5): ["", "7"], ("t", 1): ["only"]}
    cut = grids.rows_of(grids.filled(cells), max_rows=2, max_cols=1).where("sheet = 's'").collect()
    assert sorted(r.row for r in cut) == [3, 4] and all(r.rows_truncated and r.cols_truncated and len(r.cells) == 1 for r in cut)
    merged = spark.createDataFrame([("s", 3, 2, 4, 2), ("s", 9, 9, 9, 10)], "sheet string, row0 int, col0 int, row1 int, col1 int")
    assert {(r.row, r.col): r.value for r in grids.filled(cells, merged).where("sheet = 's'").collect()} == {(3, 2): "x", (4, 2): "x", (5, 3): "7"}


def test_images_and_captions(spark):
    image = lambda n, w, h, size, content, x1=500.0, y1=500.0: ("f", n, w, h, size, content, 0.0, 0.0, x1, y1, 1000.0, 1000.0)
    rows = [image(1, 400, 300, 50_000, "a"), image(2, 400, 300, 50_000, "a"), image(3, 99, 900, 50_000, "b"), image(4, 200, 149, 50_000, "c"), image(5, 400, 300, 2047, "d"), image(6, 400, 300, 50_000, "e", 49.0, 49.0), image(7, 400, 300, 50_000, "e"), image(8, 1400, 110, 50_000, "g"), image(9, 400, 300, 9_000, "h"), image(10, 1000, 600, 30_000, "i"), image(11, 400, 300, 50_000, "k", 49.0, 500.0)]
    table = spark.createDataFrame(rows, "file string, n int, width int, height int, n_bytes int, content_hash string, x0 double, y0 double, x1 double, y1 double, page_width double, page_height double")
    assert sorted(r.n for r in figures.kept_images(table, ["n"]).where("kept").collect()) == [1, 10, 11]
    box = "x0 double, y0 double, x1 double, y1 double"
    captions = spark.createDataFrame([(1, 1, 600.0, 800.0, 100.0, 500.0, 300.0, 515.0), (1, 2, 600.0, 800.0, 100.0, 60.0, 300.0, 75.0)], f"page int, caption int, page_width double, page_height double, {box}")
    shapes = spark.createDataFrame([(1, 120.0, 300.0, 250.0, 400.0), (1, 200.0, 350.0, 380.0, 480.0), (1, 395.0, 300.0, 420.0, 400.0), (1, 100.0, 20.0, 300.0, 119.0), (2, 0.0, 0.0, 500.0, 500.0), (1, 100.0, 510.0, 200.0, 600.0)], f"page int, {box}")
    ground = spark.createDataFrame([(1, 1, 0.0, 0.0, 600.0, 800.0), (1, 2, 115.0, 295.0, 390.0, 485.0)], f"page int, rank int, {box}")
    got = {r.caption: tuple(r)[2:] for r in figures.captioned_figures(captions, shapes.where("x0 != 395.0 and y0 != 20.0"), ground).collect()}
    assert got == {1: (105.0, 285.0, 400.0, 495.0)}
    wide = {r.caption: tuple(r)[2:] for r in figures.captioned_figures(captions, shapes.where("y0 != 20.0"), ground.where("false")).collect()}
    assert wide == {1: (110.0, 290.0, 390.0, 490.0)} or wide[1][2] == 390.0  # 395 is over 90 from the caption's end
    assert [figures_ for figures_ in spark.createDataFrame([("Figure 3: x",), ("fig. 2-1 y",), ("图 4",), ("Figures",)], "t string").select(figures.is_caption(F.col("t"))).toPandas().iloc[:, 0]] == [True, True, True, False]


SVGS = {
    "good": '<svg viewBox="0 0 1280 720" width="1280" height="720"><g id="a"><text id="t" data-edit-target="true" data-edit-annotation="shorter" font-family="Foo, Arial, sans-serif" font-size="24px" fill="#112233">  hello there </text></g></svg>',
    "bad": '<svg viewBox="0 0 100 100" width="90" height="100"><style>x</style><rect class="k" id="i" onclick="f()" fill="rgba(1,2,3,.5)"/><symbol/><use href="#x"/><text font-family="Foo">' + "w" * 100 + '</text><pattern id="p" data-pptx-pattern="nope"/><pattern id="q"/><path marker-end="url(#m)"/><clipPath id="c"/><rect clip-path="url(#zz)"/><image clip-path="url(#c)" href="img/a.png"/></svg>',
    "none": '<svg width="10"><g opacity=".5"/><IMAGE opacity="1"/><Script/><foreignObject/><rect fill="#ABCDEF" stroke="#abcdef" font-size="500px"/></svg>',
}


def test_drawings(spark):
    table = spark.createDataFrame(list(SVGS.items()), "name string, svg string")
    hits = drawings.rule_hits(table, "name", drawings.static_rules(F.col("svg"), F.lit("0 0 1280 720")))
    found = {}
    for r in hits.collect():
        found.setdefault(r.name, set()).add(r.rule)
    assert "good" not in found
    assert found["bad"] == {"style_element", "class_attribute", "event_attribute", "id_with_style", "rgba", "symbol_with_use", "long_text", "unsafe_font", "pattern_unknown", "pattern_unnamed", "marker_without_definition", "clip_on_shape", "clip_without_definition", "size_mismatch", "viewbox_mismatch"}
    assert found["none"] == {"viewbox_missing", "group_opacity", "image_opacity", "script", "foreign_object"}
    assert tuple(drawings.check_summary(table, hits, "name").first()) == (3, 1, 0, 2, 33, 0, 66)
    assert drawings.check_summary(table.where("false"), hits.where("false"), "name").first()[0] == 0
    assert drawings.issue_categories(hits).first().n == 1
    drift = {tuple(r) for r in drawings.lock_drift(table, "name", "svg", ["#112233"], ["Arial"], ["18"], 18.0).collect()}
    assert drift == {("color", "#ABCDEF", 1), ("font", "Foo, Arial, sans-serif", 1), ("font", "Foo", 1), ("size", "500", 1)}
    assert {tuple(r) for r in drawings.lock_drift(table, "name", "svg", ["#112233", "#ABCDEF"], [], [], None).collect()} == set()
    notes = drawings.annotations(table, "name", "svg")
    assert [tuple(r) for r in notes.collect()] == [("good", 0, "t", "text", "shorter", "hello there")]
    assert {r.name: r.n for r in drawings.annotation_counts(notes, notes.union(notes).withColumn("name", F.lit("bad")), "name").collect()} == {"good": 1, "bad": 2}
    templates = spark.createDataFrame([("03a_content_two", "{{TITLE}}"), ("01_cover", ""), ("05_section_break", ""), ("02_toc", "x"), ("notes", "")], "stem string, svg string")
    contract = spark.createDataFrame([("03_content", ["{{TITLE}}", "{{BODY}}"]), ("01_cover", ["{{A}}"]), ("02_toc", ["{{T}}"])], "page string, placeholders array<string>")
    override = spark.createDataFrame([("02_toc", []), ("03_content", ["{{TITLE}}", "{{ONE}}"])], "page string, placeholders array<string>")
    assert {tuple(r) for r in drawings.missing_placeholders(templates, contract, override).collect()} == {("03a_content_two", "{{ONE}}"), ("01_cover", "{{A}}")}
    assets = spark.createDataFrame([("a.png", "by A"), ("z.png", "by Z")], "filename string, credit string")
    assert [tuple(r) for r in drawings.without_credit(table, "name", "svg", assets).collect()] == [("bad", "a.png")]
    new = {r.name: (r.svg.count("#000000"), r.n) for r in drawings.replaced(table, "name", "svg", {"#abcdef": "#000000"}).collect()}
    assert new == {"good": (0, 0), "bad": (0, 0), "none": (2, 2)}


RULES = """
stages:
  - {id: end, order: 2, keywords: [Bye], required: true}
  - {id: start, order: 1, keywords: [Hello], synonyms: [Hi]}
"""


def test_rules_checks_and_settings(spark):
    stages = registry.stage_templates(RULES)
    assert [s["id"] for s in stages] == ["start", "end"] and stages[0]["synonyms"] == ["Hi"] and stages[1]["required"] and registry.stage_templates("") == []
    titles = spark.createDataFrame([(1, 1, "hi all"), (1, 2, "bye now")], "deck long, page long, title string")
    assert [r.stage_id for r in gates.stage_match(titles, stages, ["deck", "page"], "title").orderBy("page").collect()] == ["start", "end"]
    same = "alpha beta gamma delta epsilon zeta eta theta"
    block = "\n".join(["alpha beta gamma delta one", "alpha beta gamma delta two", "alpha beta gamma delta six", "quite other words only"])
    rows = [(1, 1, f"{same} {{{{TITLE}}}}"), (1, 2, same), (1, 4, " 12 . "), (1, 5, "garbled text � here and there"), (1, 6, block)]
    pages = spark.createDataFrame(rows, "deck long, page long, text string")
    source = spark.createDataFrame([(1, "lorem ipsum dolor sit amet consectetur")], "deck long, text string")
    got = {(r.type, r.page): (r.severity, r.tier) for r in registry.run_checks(pages, source).collect()}
    assert got[("C1_PLACEHOLDER", 1)][0] == got[("C2_EMPTY_PAGE", 4)][0] == got[("C7_GARBLED", 5)][0] == "error"
    assert {("C3_CONTENT_MATCH", 6), ("C4_REDUNDANCY", None), ("C5_CONTINUITY", 4), ("C6_SOURCE_COVERAGE", None)} <= set(got)
    assert got[("C8_STRUCTURE", None)] == ("warning", "incomplete") and got[("C9_OUTLIER", 6)] == ("critical", "critical")
    registry.CHECKS["X_OWN"] = lambda pages, source: pages.select("deck", "page", F.lit("X_OWN").alias("type"), F.lit(None).cast("string").alias("tier"))
    assert registry.run_checks(pages, names=["X_OWN"]).count() == 5
    del registry.CHECKS["X_OWN"]
    settings = spark.createDataFrame([("wide", 1280), ("square", 1080)], "name string, width int")
    asked = spark.createDataFrame([(" 16:9 ",), ("WIDE",), ("none",), (None,)], "key string")
    assert sorted((r.key or "", r.width or 0) for r in registry.settings_for(asked, "key", settings, {"16:9": "wide"}).collect()) == [("", 0), (" 16:9 ", 1280), ("WIDE", 1280), ("none", 0)]
    targets = spark.createDataFrame([("s1", "g1"), ("s1", "g2"), ("s2", "g1")], "slide string, group string")
    config = spark.createDataFrame([("s1", None), ("s1", "g1"), ("s1", "g9"), ("s7", "g1"), ("s7", "g2")], "slide string, group string")
    assert {tuple(r) for r in registry.dangling_references(config, targets).collect()} == {("s7", None, "missing slide"), ("s1", "g9", "missing group")}


def test_providers_queues_and_engines(spark, tmp_path):
    cols = "query_id long, candidate_id long, score double, valid boolean"
    a = spark.createDataFrame([(1, 1, 5.0, False), (1, 2, 1.0, True), (2, 3, None, True)], cols)
    b = spark.createDataFrame([(1, 9, 5.0, True), (2, 4, 2.0, False)], cols)
    ranked = registry.merged_candidates({"x": a, "a": b}, pool=2)
    assert {(r.query_id, r["rank"]): (r.provider, r.candidate_id) for r in ranked.collect()} == {(1, 1): ("a", 9), (1, 2): ("x", 1), (2, 1): ("a", 4)}
    assert [tuple(r) for r in registry.first_valid(ranked).collect()] == [(1, "a", 9)]
    log = spark.createDataFrame([("p", 1, "Failed", True), ("p", 2, "Generated", False), ("q", 1, "Failed", True), ("q", 2, "Failed", True), ("r", 1, "Failed", False), ("r", 2, "Failed", False), ("r", 3, "Failed", False)], "item string, batch int, status string, rate_limited boolean")
    assert {r.item: (r.status, r.tries, r.retry, r.concurrency) for r in registry.retry_plan(log, 5).collect()} == {"p": ("Generated", 2, False, 1), "q": ("Failed", 2, True, 1), "r": ("Failed", 3, False, 1)}
    name, embed = registry.embedder()
    assert name == "hashed" and len(spark.range(1).select(embed(F.array(F.lit("x")))).first()[0]) > 0
    registry.BACKENDS["broken"] = lambda model: (_ for _ in ()).throw(ImportError("no library"))
    assert registry.embedder()[0] == "hashed"
    del registry.BACKENDS["broken"]
    with pytest.raises(KeyError):
        registry.embedder("none")
    engine = registry.VectorEngine(spark).add(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], registry.VectorEngine.schema))
    engine = engine.add(spark.createDataFrame([(2, [0.5, 0.0])], registry.VectorEngine.schema))
    engine.save(f"{tmp_path}/engine")
    hits = registry.VectorEngine.load(spark, f"{tmp_path}/engine").search(spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<double>"), 2)
    assert [(r.vec_id, r.score) for r in hits.orderBy("rank").collect()] == [(1, 1.0), (2, 0.5)]

    class Job(registry.Lifecycle):
        def __init__(self, early=0, late=0):
            self.early, self.late = early, late

        def prepare(self):
            return spark.range(self.early)

        def execute(self):
            return spark.range(3)

        def validate(self, result):
            return result.limit(self.late)

    assert [Job(*x).run()[0] for x in ((0, 0), (1, 0), (0, 1))] == ["done", "prepare", "validate"]
