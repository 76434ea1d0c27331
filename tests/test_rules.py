"""Rules of texts, headings, blocks, slots and layouts, each against values that their definitions give."""

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import gates, layout
from paperloom.operators import structure as S


def each(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"n int, x {kind}")
    return [r.y for r in rows.select("n", f(F.col("x")).alias("y")).orderBy("n").collect()]


def test_slugs_and_file_names(spark):
    assert each(spark, ["  Hello, world!  ", "a/b/Plan v2.1.pptx", "年度 报告.docx", "***", None, "x" * 40, "__a__b-c__"], X.slug) == ["Hello_world", "Plan_v2_1", "年度_报告", "image", "image", "x" * 30, "a_b_c"]
    names = spark.createDataFrame([("A  b: c!", "http://h/x"), ("", "http://h.org/a/b-c.html?q"), (None, "https://h.org/"), ("?!", "nothing"), ("é__中", "u")], "t string, u string")
    assert [r.b for r in names.select(X.url_base_name(F.col("t"), F.col("u")).alias("b")).collect()] == ["A_b_c", "horg_abchtml", "horg", "untitled", "_中"]


def test_titles_lose_names_of_sites_only(spark):
    assert each(spark, ["Spark - a guide", "通知 - 某市政府", "a|b_数据门户 x", "网站", "x|委员会", None], X.clean_title) == ["Spark - a guide", "通知", "a", "网站", "x", ""]


def test_spoken_text(spark):
    md = "# Head\n\n\nOne **bold** and *it*, _u_ ~~gone~~ `c` [l](u).  \n   \n\n  ## Sub\nTwo __b__\n- item\n"
    assert each(spark, [md, "#", "a\r\nb", ""], X.spoken) == ["One bold and it, u gone c l.\n\nTwo b\n- item", "", "a\nb", ""]


def test_credits(spark):
    rows = [("f.png", "u", "T", "A", "wikimedia", "CC BY", "http://l"), ("", "u", None, "", "", "", "http://l"), (None, None, "T", None, "own", "CC0", None)]
    df = spark.createDataFrame(rows, "f string, u string, t string, a string, p string, l string, v string")
    got = [r.c for r in df.select(X.attribution(*[F.col(c) for c in "futaplv"]).alias("c")).collect()]
    assert got == ['f.png — "T" by A via Wikimedia Commons — license: CC BY (http://l)', "u — via unknown — license: http://l", 'image — "T" via own — license: CC0']


def test_page_metadata(spark):
    pages = [
        ('<title>A - 某门户</title><meta property="OG:description" content="d &amp; e"><meta name="date" content="2020-01-01"><meta content="first" name="author">', "http://h/x"),
        ("<p>发布时间：2024年3月5日</p> 来源：新华社 x", "http://h/201911/t20_1.html"), ("<title></title><meta property='og:title' content='T'>", "http://h/201911/t20_1.html"), ("", "http://h/2021/02/03/a"), ("<p>发布机构: 局</p>", "http://h/a"),
    ]
    m = S.page_metadata(F.col("h"), F.col("u"))
    got = [tuple(r) for r in spark.createDataFrame(pages, "h string, u string").select(*[m[k].alias(k) for k in ("title", "date", "description", "author")]).collect()]
    assert got == [("A", "2020-01-01", "d & e", "first"), ("Untitled", "2024-3-5", "", "新华社"), ("T", "2019-11", "", ""), ("Untitled", "2021-02-03", "", ""), ("Untitled", "", "", "局")]


def test_heading_levels(spark):
    rows = [(20.0, "Title", False), (19.4, "x", True), (16.0, "1. Overview.", False), (16.0, "A sentence.", False), (13.0, "plain", False), (13.0, "bold", True), (12.0, "body", True), (20.0, "y" * 81, True), (14.0, "14", False)]
    sizes = {"h1": F.lit(20.0), "h2": F.lit(16.0), "h3": F.lit(13.0), "body": F.lit(12.0)}
    df = spark.createDataFrame(rows, "s double, t string, b boolean")
    assert [r.v for r in df.select(S.heading_level(F.col("s"), sizes, F.col("t"), F.col("b")).alias("v")).collect()] == [1, 2, 2, 0, 0, 3, 0, 0, 3]
    none = {k: F.lit(None).cast("double") for k in sizes}
    assert [r.v for r in df.limit(1).select(S.heading_level(F.col("s"), none, F.col("t"), F.col("b")).alias("v")).collect()] == [0]


def test_list_items_and_footers(spark):
    assert each(spark, [" ● x", "▸y", "- z", "-z", "* a", "1234. x", "7、b", "3)", "(1) x", "text"], S.list_item) == ["- x", "- y", "- z", None, "- a", "1234. x", "7. b", "3. ", None, None]
    assert each(spark, ["Body November 2025 8", "正文 2025年11月 8 ", "Page 3 of 9", "x MAY 2024 1234", "a  "], S.without_footer) == ["Body", "正文", "Page 3 of 9", "x MAY 2024 1234", "a"]


def test_running_heads_of_top_and_bottom(spark):
    deck = lambda doc, n: [(doc, p, "Head", 0.0, 50.0, 1000) for p in range(n)] + [(doc, p, "mid", 400.0, 450.0, 1000) for p in range(n)] + [(doc, p, " Foot ", 900.0, 950.0, 1000) for p in range(n // 2)]
    rows = deck("a", 10) + deck("two", 2) + [("long", p, f"{'x' if p < 20 or p >= 80 else 'y'}", 10.0, 20.0, 1000) for p in range(100)] + [("a", p, "Both", 100.0 if p < 4 else 990.0, 1000.0, 1000) for p in range(8)]
    blocks = spark.createDataFrame(rows, "doc string, page int, t string, y0 double, y1 double, height int")
    got = {(r.doc, r.t): (r.times, r.pages) for r in S.repeated_blocks(blocks, "doc", "page", "t").collect()}
    assert got == {("a", "Head"): (10, 10), ("long", "x"): (40, 40)}
    noise = S.repeated_blocks(blocks, "doc", "page", "t")
    left = S.without_noise(spark.createDataFrame([("a", "Head"), ("a", " Head \nkeep"), ("b", "Head"), ("a", "mid")], "doc string, t string"), noise, "doc", "t")
    assert sorted(r.t for r in left.collect()) == ["Head", "keep", "mid"]


def test_lines_of_paragraphs(spark):
    rows = [(1, "first line", None), (2, "", None), (3, "second para", None), (4, "goes on.", None), (5, "Next", None), (6, "HEAD", "h"), (7, "body；", None), (8, "- item", "i"), (9, "x", None), (10, "y", None)]
    df = spark.createDataFrame([("d", *r) for r in rows], "doc string, n int, t string, k string")
    got = [r.t for r in S.joined_lines(df, "doc", "n", "t", F.col("k") == "h", F.col("k") == "i").orderBy("block").collect()]
    assert got == ["first line ", "second para goes on.", "Next", "HEAD", "body；", "- item", "x y"]


def test_chunk_sizes(spark):
    assert each(spark, [0, 65000, 100000, 80000, 79000, 10**6], S.safe_chunk_pages, "long") == [3, 3, 15, 5, 5, 15]
    rows = spark.createDataFrame([(1, 1, 22), (2, 5, 5), (3, 0, 9)], "k int, a long, b long")
    got = [(r.k, r.chunk_last - r.chunk_first + 1) for r in S.even_chunks(rows, "a", "b", 10).orderBy("k", "chunk").collect()]
    assert got == [(1, 8), (1, 7), (1, 7), (2, 1), (3, 10)]


def test_sections_and_single_pages(spark):
    def chunks(starts, last, most):
        rows = spark.createDataFrame([("c", s, last) for s in starts], "c string, s int, e int")
        return sorted((r.first, r.last) for r in S.split_at_sections(rows, "c", "s", "e", most).collect())

    assert chunks([1], 22, 10) == [(1, 8), (9, 15), (16, 22)]
    assert chunks([1, 6, 11, 12], 12, 10) == [(1, 10), (11, 12)]
    assert chunks([1, 11], 11, 10) == [(1, 11)]  # a last page alone joins the one before
    assert chunks([1, 3, 4], 5, 2) == [(1, 3), (4, 5)]


def test_gap_thresholds(spark):
    counts = spark.createDataFrame([(1, 4, 9, 3, 6), (3, 3, 2, 9, 9), (1, 1, 9, 12, 1)], "a int, b int, c int, d int, e int")
    gap = lambda preferred: [r.g for r in counts.select(S.best_gap([(n, F.col(c)) for n, c in enumerate("abcde")], preferred).alias("g")).collect()]
    assert gap(0) == [3, 0, 0] and gap(4) == [1, 0, 0]


def test_balanced_blocks_and_overflow(spark):
    blocks = spark.createDataFrame([("a", 1, "A"), ("a", 2, "B"), ("b", 1, "x1\nx2\n\nx3"), ("b", 2, "y"), ("b", 3, "z"), ("b", 4, "w")], "g string, n int, t string")
    slots = spark.createDataFrame([("a", 3), ("b", 3), ("none", 2)], "g string, slots int")
    new = S.balanced_blocks(blocks, slots, "g", "n", "t")
    assert sorted(map(tuple, new.collect())) == [("a", 1, "A"), ("a", 2, "B"), ("a", 3, "B"), ("b", 1, "x1\nx2\n\nx3\n\ny"), ("b", 2, "z\n\nw"), ("b", 3, "")]
    old = spark.createDataFrame([("b", 1, 1, "o1"), ("b", 1, 2, "o2"), ("b", 2, 1, "z"), ("b", 2, 2, "o4"), ("b", 2, 3, "o5"), ("b", 3, 1, "o6")], "g string, slot int, p int, t string")
    got = sorted(tuple(r)[1:] for r in S.paragraph_map(old, new, "g", "p", "t").collect())
    assert got == [(1, 1, "o1", "x1"), (1, 2, "o2", "x2；x3；y"), (2, 2, "o4", "w")]


def test_slot_capacity_and_assignment(spark):
    rows = [(914400, 914400, 12.0), (914400, 0, 12.0), (0, 914400, 12.0), (914400, 914400, None), (91440, 91440, 40.0), (914400, 914400, 0.0)]
    df = spark.createDataFrame(rows, "w long, h long, s double")
    assert [r.c for r in df.select(S.slot_capacity(F.col("w"), F.col("h"), F.col("s")).alias("c")).collect()] == [10 * 4, 10, 0, 40, 1, 0]
    slots = spark.createDataFrame([("g", 1, 40, 0, 0), ("g", 2, 90, 5, 0), ("g", 3, 40, 0, -1), ("g", 4, 1, 0, 0)], "g string, slot int, capacity long, top int, left int")
    texts = spark.createDataFrame([("g", 7, "x" * 50), ("g", 8, "x" * 95), ("g", 9, "y")], "g string, c int, t string")
    got = {r.slot: (r.c, r.over) for r in S.assigned_slots(texts, slots, "g", "c", "t", "slot").collect()}
    assert got == {2: (8, True), 3: (7, True), 1: (9, False), 4: (None, False)}


def test_slide_roles(spark):
    rows = [(1, 5, "Thank you all", 1, 0, 1), (1, 5, "Our AGENDA", 1, 0, 1), (2, 5, "Part two", 9, 0, 99), (1, 5, "x", 9, 3, 99), (1, 5, "x", 9, 4, 99), (5, 5, "x", 6, 9, 99), (5, 5, "x", 7, 9, 99), (3, 5, "x", 3, 9, 12), (3, 5, "x", 3, 9, 13)]
    df = spark.createDataFrame(rows, "i int, n int, t string, k int, p int, s int")
    got = [r.r.removesuffix("_candidate") for r in df.select(S.slide_role(*[F.col(c) for c in "intkps"]).alias("r")).collect()]
    assert got == ["ending", "toc", "chapter", "cover", "content", "ending", "content", "chapter", "content"]


def test_chapters_and_front_matter(spark):
    pages = [("a", 0, "x" * 60), ("a", 1, "short"), ("a", 2, "第 1 章 Start\nbody"), ("a", 3, ""), ("a", 5, "第2章End"), ("a", 6, ""), ("b", 0, "x" * 60), ("b", 1, "第3章 x"), ("c", 0, " "), ("c", 2, "第4章 y")]
    df = spark.createDataFrame(pages, "doc string, page long, t string")
    found = S.chapters(df, "doc", "page", "t")
    assert sorted(map(tuple, found.select("doc", "chapter", "title", "start", "end", "pages").collect())) == [("a", 1, "Start", 2, 4, 3), ("a", 2, "End", 5, 6, 2), ("b", 3, "x", 1, 1, 1), ("c", 4, "y", 2, 2, 1)]
    assert [tuple(r) for r in S.front_matter(df, "doc", "page", "t", found).collect()] == [("a", 1)]


def test_font_shrink_and_verification(spark):
    got = each(spark, [10, 15, 16, 30, 31, 40, 50, 51, 80, 81, 500], lambda n: gates.fitted_size(F.lit(20), n), "int")
    assert got == [20, 20, 19, 19, 18, 18, 18, 16, 16, 14, 14]
    assert each(spark, [90, 20], lambda n: gates.fitted_size(F.lit(9), n), "int") == [8, 8] and each(spark, [3], lambda n: gates.fitted_size(F.lit(6), n), "int") == [6]
    slides = spark.createDataFrame([("d", 1, ["ok", " 中文 ", "", None], "ff0000"), ("d", 2, ["x" * 101], None), ("e", 1, ["かな"], "FF0000"), ("e", 2, None, "00ff00")], "deck string, slide int, texts array<string>, bg string")
    rows = {(r.deck, r.slide): (r.background_ok, r.left_over, r.long_texts, r.passed) for r in gates.slide_verification(slides, "deck", "slide", "texts", "bg", "FF0000").collect()}
    assert rows == {("d", 1): (True, 1, 0, False), ("d", 2): (False, 0, 1, False), ("e", 1): (True, 0, 0, True), ("e", 2): (False, 0, 0, False)}
    free = gates.deck_verification(gates.slide_verification(slides, "deck", "slide", "texts", "bg", lang="ja"), "deck")
    assert sorted(map(tuple, free.collect())) == [("d", 2, 2, 2, 1, False), ("e", 2, 2, 1, 2, False)]


def test_layouts(spark):
    df = spark.createDataFrame([(3.0,), (1.6,), (1.0,), (1.5,), (0.4,)], "r double")
    found = layout.text_beside_image(F.col("r"), 1160, 560)
    got = [tuple(r) for r in df.select(*[found[k].alias(k) for k in ("layout", "image_w", "image_h", "text_w", "text_h")]).collect()]
    assert got == [("top-bottom", 1160, 387, 1160, 153), ("left-right", 812, 508, 328, 560), ("left-right", 560, 560, 580, 560), ("left-right", 840, 560, 300, 560), ("left-right", 224, 560, 916, 560)]
    images = spark.createDataFrame([(n, i) for n in (1, 2, 3, 4, 7) for i in range(1, n + 1)], "s int, idx long")
    boxes = {}
    for r in layout.arrange(images, "s", 1000, 900, margin=50, gap=20, title_height=100).orderBy("s", "idx").collect():
        boxes.setdefault(r.s, []).append((r.x, r.y, r.width, r.height))
    assert boxes[1] == [(50, 150, 900, 700)] and boxes[2] == [(50, 150, 440, 700), (510, 150, 440, 700)]
    assert boxes[3] == [(50, 150, 900, 340), (50, 510, 440, 340), (510, 510, 440, 340)]
    assert boxes[4][3] == (50, 510, 286, 340) and boxes[7][6] == (50, 150 + 2 * (220 + 20), 286, 220)


@pytest.mark.parametrize("most", [1])
def test_stage_match_of_a_long_template(spark, most):
    stages = [{"id": f"s{n}", "order": n, "required": n < 2, "keywords": [f"word{n}x{k}" for k in range(6)], "synonyms": [f"syn{n}x{k}" for k in range(6)]} for n in range(10)]
    pages = spark.createDataFrame([("d", 1, "word3x1 and syn3x2"), ("d", 2, "syn9x5"), ("d", 3, ""), ("d", 4, "WORD1x0")], "deck string, page int, title string")
    m = gates.stage_match(pages, stages, ["deck", "page", "title"], "title")
    assert {r.page: (r.stage_id, r.score) for r in m.collect()} == {1: ("s3", 18), 2: ("s9", 8), 3: (None, 0), 4: ("s1", 13)}
    report = gates.gate_report(m, stages, "deck", "page", "title").first()
    assert (report.pages, report.unmatched, report.missing, report.violations, report.passed) == (4, 1, 1, 1, False)


def test_project_names(spark):
    names = ["Deck_ppt169_20240131", "d_XHS_20240230", "a_b_story", "deck-20240131", "x_wechat_moment_20240101", "x_wechat-moment_20240101", "朋友圈_20240101", "n_unknown_20240101", "a_A4"]
    df = spark.createDataFrame([(n,) for n in names], "t string")
    parts = X.project_name(F.col("t"))
    got = [(r.n, r.f, str(r.d)) for r in df.select(parts["name"].alias("n"), parts["format"].alias("f"), parts["date"].alias("d")).collect()]
    assert got == [
        ("Deck", "ppt169", "2024-01-31"), ("d", "xiaohongshu", "None"), ("a_b", "story", "None"), ("deck-20240131", None, "None"), ("x_wechat_moment", None, "2024-01-01"), ("x", "moments", "2024-01-01"), ("朋友圈", None, "2024-01-01"),
        ("n_unknown", None, "2024-01-01"), ("a", "a4", "None"),
    ]
