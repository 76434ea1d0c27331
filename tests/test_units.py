"""Cases that the driver's tables can't reach: Chinese text, ties, odd inputs, files and streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as X
from paperloom.operators import dedup, gates, joins, search, structure
from paperloom.sources import files, indexes
from paperloom.streaming import changes


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first().r if values else spark.range(1).select(column.alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "have", "lack"),
    [
        ("金融行业数字化转型方案 AI", {"金融", "数字化", "ai", "金融行业数字化转型方案"}, {"金"}),
        ("微服务架构设计", {"微服务", "架构", "微服务架"}, set()),
        ("一", {"一"}, set()),
        ("三个字", {"三个字"}, {"三个"}),
        ("éa ab 42x", {"ab", "42"}, {"a", "éa", "x"}),
        ("", set(), {""}),
    ],
)
def test_search_tokens(spark, text, have, lack):
    got = set(one(spark, X.search_tokens(F.lit(text))))
    assert have <= got and not lack & got


def test_content_tokens_join_chinese_across_gaps(spark):
    assert one(spark, X.content_tokens(F.lit("微服务 ab12 架构"))) == ["ab12", "微服", "服务", "务架", "架构", "微服务", "服务架", "务架构"]
    assert one(spark, X.content_tokens(F.lit("可以"))) == []
    assert one(spark, X.content_tokens(F.lit(None).cast("string"))) == []


@pytest.mark.parametrize(("run", "want"), [("a", False), ("ab", True), ("x" * 30, True), ("x" * 31, False), ("12.5", False), ("--", False), ("v2", True)])
def test_keyword_bounds(spark, run, want):
    assert one(spark, X.is_keyword(F.lit(run))) is want


def test_hybrid_scores(spark):
    def score(query, vector, text, words):
        tokens = one(spark, X.search_tokens(F.lit(query)))
        return one(spark, search.hybrid_score(F.lit(vector), search.keyword_subscore(tokens, F.lit(text), search.string_array(words), F.lit(""), F.lit(""))))

    assert score("云计算", 0.9, "云计算 平台", ["云计算"]) > 0.85
    assert score("云计算", 0.5, "云原生部署方案", []) >= 0.34
    assert score("区块链", 0.2, "财务报表", []) < 0.4
    assert score("ab", 0.99, "ab", []) <= 1.0


def test_title_quality(spark):
    for title, want in [("", "empty"), ("  ", "empty"), ("短", "weak"), ("关于我们的", "weak"), ("概述一二三四", "weak"), ("收入增长三成", "strong"), ("平台架构图", "neutral"), ("甲乙丙丁", "weak"), ("甲乙丙丁戊己", "neutral")]:
        assert one(spark, gates.title_quality(F.lit(title))) == want, title


def test_license_names_and_tiers(spark):
    assert one(spark, X.license_name(F.lit("cc by sa 4.0"))) == "CC BY-SA 4.0"
    assert one(spark, X.license_name(F.lit("CC0"))) == "CC0"
    tier = lambda n, p="": one(spark, X.license_tier(F.lit(n), F.lit(""), F.lit(p)))
    assert tier("CC BY-NC 4.0") is None and tier("CC0") == "no-attribution" and tier("CC BY 4.0") == "attribution-required"
    assert tier("Pexels", "pexels") == "no-attribution" and tier("", "pexels") is None and tier("whatever") is None


def test_greedy_order_and_strict_threshold(spark):
    # i~j and j~k but not i~k: j goes, k stays
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.8, 0.6]), (2, [0.28, 0.96])], "vec_id long, embedding array<double>")
    pairs = dedup.similar_pairs(v, 0.7)
    assert sorted(map(tuple, pairs.collect())) == [(0, 1), (1, 2)]
    assert {r.vec_id: r.kept for r in dedup.greedy_keep(v, pairs, "vec_id").collect()} == {0: True, 1: False, 2: True}
    assert dedup.similar_pairs(v, 0.8).where("i = 0 and j = 1").count() == 0  # equal to the threshold
    assert dedup.similar_pairs(v, 0.7, block=1).count() == 2


def test_stage_ties_and_least_score(spark):
    stages = [{"id": "a", "order": 1, "keywords": ["x1"]}, {"id": "b", "order": 2, "keywords": ["x2"]}]
    pages = spark.createDataFrame([(1, 1, "x1 x2"), (1, 2, "nothing"), (1, 3, ""), (1, 4, "x2 only"), (1, 5, "x1")], "deck int, page int, title string")
    m = gates.stage_match(pages, stages, ["deck", "page"], "title")
    assert {r.page: r.stage_id for r in m.collect()} == {1: "a", 2: None, 3: None, 4: "b", 5: "a"}
    assert [r.page for r in gates.order_violations(m, "deck", "page").collect()] == [5]


def test_closure_with_cycle_and_diamond(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4), (4, 1), (9, 8)], "src long, dst long")
    assert sorted(r.node for r in joins.closure(edges, spark.createDataFrame([(1,)], "node long")).collect()) == [1, 2, 3, 4]


def test_collapse_bounds(spark):
    issues = spark.createDataFrame([(n, p, f"T{n}", None) for n in (10, 11, 15, 16) for p in range(n)], "deck int, page int, type string, tier string")
    got = {r.deck: (r.collapsed, r.hint, len(r.sample_pages)) for r in gates.collapse(issues, "deck").collect()}
    assert got == {10: (False, False, 5), 11: (True, False, 5), 15: (True, False, 5), 16: (True, True, 5)}


def deck(slides):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, texts in slides.items():
            z.writestr(f"ppt/slides/slide{n}.xml", "<p:sld>" + "".join(f"<a:t>{t}</a:t>" for t in texts) + "</p:sld>")
            z.writestr(f"ppt/slides/_rels/slide{n}.xml.rels", '<Relationship Id="r1" Type="t" Target="../media/i.png"/>')
    return out.getvalue()


def test_slide_source(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.pptx").write_bytes(deck({2: ["Zwei", " "], 10: ["Ten", "x", "12"], 1: ["Eins"]}))
    (tmp_path / "~$a.pptx").write_bytes(b"lock")
    (tmp_path / "bad.pptx").write_bytes(b"no zip")
    found = files.scan(spark, str(tmp_path), "*.pptx")
    assert found.count() == 2
    rows = {r.slide_num: (r.text, r.keywords) for r in files.slides(found).collect()}
    assert rows == {1: ("Eins", ["Eins"]), 2: ("Zwei", ["Zwei"]), 10: ("Ten x 12", ["Ten"])}
    assert [tuple(r)[1:] for r in files.slide_images(found).collect()] == [("../media/i.png", 10)]


def test_index_readers(spark, tmp_path):
    index = {"files": {"金融/业务方案.pptx": {"title": "业务方案", "slides": {"1": "数字化", "2": "云"}, "slide_keywords": {"1": ["数字化"]}}, "科技/AI方案.pptx": {"title": "AI", "slides": {"1": "模型"}}}}
    (tmp_path / "i.json").write_text(json.dumps(index, ensure_ascii=False))
    rows = indexes.slide_entries(indexes.read_slide_index(spark, str(tmp_path / "i.json"))).orderBy("source_id").collect()
    assert [r.source_id for r in rows] == sorted(["金融/业务方案.pptx::1", "金融/业务方案.pptx::2", "科技/AI方案.pptx::1"])
    (tmp_path / "m.json").write_text(json.dumps({"images": {"img_001.jpg": {"description_hint": "h", "search_tags": ["a"], "slide_number": "3"}, "img_002.jpg": {"archive_name": "n"}}}))
    rows = {r.source_id: r for r in indexes.image_entries(indexes.read_image_index(spark, str(tmp_path / "m.json"))).collect()}
    assert rows["img_001.jpg"].slide_number == 3 and rows["img_002.jpg"].display_text == "n"


def test_provider_payloads(spark):
    p = lambda x: spark.createDataFrame([(json.dumps(x),)], "payload string")
    assert indexes.openverse(p({"results": [{"title": "t", "creator": "c", "license": "by", "license_version": "4.0", "url": "u"}, {"title": "no url"}]})).count() == 1
    w = indexes.wikimedia(p({"query": {"pages": {"7": {"title": "File:x.png", "imageinfo": [{"url": "u", "width": 2, "extmetadata": {"Artist": {"value": "<b>Me &amp; you</b>"}}}]}}}})).first()
    assert (w.title, w.author) == ("x.png", "Me & you")
    assert indexes.pexels(p({"photos": [{"alt": "a", "src": {"original": "u"}}]})).first().license == "Pexels License"
    assert indexes.pixabay(p({"hits": [{"tags": "a", "largeImageURL": "u"}]})).count() == 1


def test_job_validation_and_vectors(spark):
    jobs = spark.createDataFrame([("a", "p", "1:1", "Pending"), ("a", "p", "1:1", "Odd"), ("", "p", "", "Failed"), ("b", None, "", "Generated")], "filename string, prompt string, aspect_ratio string, status string")
    assert sorted((r.filename, r.problem) for r in indexes.validate_jobs(jobs).collect()) == [("", "no filename"), ("a", "repeated"), ("a", "unknown status"), ("b", "no prompt")]
    import numpy as np

    rows = spark.createDataFrame([(1, np.array([1.5, -2.0], "<f4").tobytes())], "id long, blob binary")
    assert indexes.decode_vectors(rows, "blob").first().embedding == [1.5, -2.0]


def test_watched_changes(spark, tmp_path):
    src, seen = tmp_path / "in", []
    snap = changes.Snapshots(spark, f"file://{tmp_path}/state", "k long, m string, o long")
    for n, rows in enumerate([[(1, "a", 1), (2, "b", 2)], [(1, "a", 3), (2, "c", 4), (3, "d", 5)]]):
        spark.createDataFrame(rows, "k long, m string, o long").write.mode("append").parquet(str(src))
        stream = spark.readStream.schema("k long, m string, o long").parquet(str(src))
        changes.watch(stream, snap, "k", "m", "o", f"{tmp_path}/log", lambda d: seen.append(sorted((r.k, r.change) for r in d.collect()))).awaitTermination()
        assert len(seen) == n + 1
    assert seen == [[(1, "new"), (2, "new")], [(2, "modified"), (3, "new")]]
    assert sorted(map(tuple, snap.read(1).collect())) == [(1, "a", 3), (2, "c", 4), (3, "d", 5)]


def test_undo(spark):
    e = spark.createDataFrame([(1, 0, True), (1, 1, False), (1, 2, False), (1, 3, True), (1, 4, False), (1, 5, True), (1, 6, True), (1, 7, True), (1, 8, False)], "s int, n int, u boolean")
    assert [r.n for r in changes.undone(e, "s", ["n"], "u").collect()] == [8]


def test_markdown_of_pages():
    main, whole = structure.markdown_of("<html><nav>menu</nav><body><main><h2>Head &amp; line</h2><p>" + "word " * 30 + "<a href='/x'>go</a></p><ul><li>one<li>two</ul></main><div>side</div></body>")
    assert main.startswith("## Head & line") and "[go](/x)" in main and "- one" in main and "menu" not in whole and "side" in whole
    assert structure.markdown_of(None) == ("", "")


def test_slice_paths(spark):
    from paperloom.operators import layout as L

    series = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 1.0), ("z", 1, 0.0)], "grp string, idx int, value double")
    pie = {r.idx: r.path for r in L.slices(series, "grp", 100.0, 0.0, 0.0).collect()}
    assert pie == {1: "M 0,0 L 0.00,-100.00 A 100.0,100.0 0 1,1 -100.00,0.00 Z", 2: "M 0,0 L -100.00,-0.00 A 100.0,100.0 0 0,1 -0.00,-100.00 Z"} or {k: v.replace("-0.00", "0.00") for k, v in pie.items()} == {1: "M 0,0 L 0.00,-100.00 A 100.0,100.0 0 1,1 -100.00,0.00 Z", 2: "M 0,0 L -100.00,0.00 A 100.0,100.0 0 0,1 0.00,-100.00 Z"}
    ring = [r.path.replace("-0.00", "0.00") for r in L.slices(series, "grp", 100.0, 0.0, 0.0, inner=50.0).orderBy("idx").collect()]
    assert ring[0] == "M 0.00,-50.00 L 0.00,-100.00 A 100.0,100.0 0 1,1 -100.00,0.00 L -50.00,0.00 A 50.0,50.0 0 1,0 0.00,-50.00 Z"


def test_rankings_that_sql_has_no_word_for(spark):
    from paperloom.operators import search as S

    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(i, rng.normal(size=8).round(3).tolist()) for i in range(200)] + [(500, [0.0] * 8)]
    queries = [(i, rng.normal(size=8).tolist()) for i in range(23)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame(queries, "query_id long, query array<double>")
    want = {(q, n + 1): v for q, x in queries for n, (_, v) in enumerate(sorted((-float(np.dot(x, e)), v) for v, e in vectors)[:4])}
    for block in (4096, 5):
        assert {(r.query_id, r["rank"]): r.vec_id for r in S.vector_topk_many(table, asked, 4, block=block).collect()} == want
    assert S.vector_topk_many(table.where("false"), asked, 4).count() == 0 and S.vector_topk_many(table, asked.where("false"), 4).count() == 0
    texts = spark.createDataFrame([(3, ["a", "b"]), (1, ["a", "c"]), (2, None), (4, ["z"])], "k long, words array<string>").repartition(3)
    items = spark.createDataFrame([(10, ["a"]), (11, ["b", "c", "z"]), (12, ["q"]), (13, None), (14, [])], "i long, words array<string>")
    assert {tuple(r) for r in S.best_text_for(texts, items, "k", "i", "words").collect()} == {(10, 1, 1.0), (11, 1, 1 / 3)}

    def length(batches):
        for pdf in batches:
            yield pdf.assign(score=pdf["words"].map(lambda w: float(len(w) if w is not None else 0)))[["k", "score"]]

    ranked = S.plugged_ranking(texts, length, "k long, score double", 2, [F.desc("score"), F.col("k")])
    assert [r.k for r in ranked.collect()] == [1, 3]
    e = spark.createDataFrame([(["x", "y", "x"],), ([],), (["x", "y", "x"],)], "w array<string>").select(S.hashed_embedding(F.col("w")).alias("e")).collect()
    assert list(e[0].e) == list(e[2].e) and abs(sum(x * x for x in e[0].e) - 1) < 1e-6 and not any(e[1].e)


def test_main_content():
    words, more = "w" * 120, "中" * 90
    assert structure.markdown_of(f"<body><nav>{'n' * 900}</nav><div>{'x' * 300}</div><article>{words}</article></body>")[0] == words  # named, though shorter
    assert structure.markdown_of(f"<div class='news-content'>{words}</div><div id='Zoom'>{more}{more}</div>")[0] == more + more  # Chinese characters count thrice
    assert structure.markdown_of(f"<div class='a TYS-MAIN-b'>{words}</div><main>{'m' * 99}</main>")[0] == words
    plain = f"<div><p>{'p' * 110}</p><p>{'q' * 110}</p></div>"
    assert structure.markdown_of(f"<div>{'x' * 260}</div>{plain}<article>{words}</article>")[0] == "p" * 110 + "\n\n" + "q" * 110  # the named one is weak
    assert structure.markdown_of("<p>short</p><footer>f</footer>") == ("short", "short") and structure.markdown_of(None) == ("", "")


def test_pages_are_unpacked_a_few_at_a_time(spark):
    n = 2 * structure.PAGES + 5
    rows = spark.createDataFrame([(i, f"<p>t{i}</p>" if i % 7 else None) for i in range(n)], "k long, html string").coalesce(1)
    out = structure.html_to_markdown(rows, "k", "html")
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in out.collect()) == [(i, *([f"t{i}" if i % 7 else ""] * 2)) for i in range(n)]


def test_numbers_and_names(spark):
    rows = spark.createDataFrame([("12. Intro",), ("3 - Plan",), ("7| x",), ("Plan 9",), ("deck_ppt169_20240131",), ("deck-20240131",)], "t string")
    got = {r.t: r.p for r in rows.select("t", X.without_number(F.col("t")).alias("p")).collect()}
    assert got["12. Intro"] == "Intro" and got["3 - Plan"] == "Plan" and got["7| x"] == "x" and got["Plan 9"] == "Plan 9"
    parts = X.project_name(F.col("t"))
    named = {r[0]: tuple(r)[1:] for r in rows.select("t", *(parts[k].alias(k) for k in sorted(parts))).collect()}
    assert {"deck", "ppt169", "2024-01-31"} <= set(map(str, named["deck_ppt169_20240131"])) and "deck-20240131" in named["deck-20240131"]




def test_headings_are_merged(spark):
    rows = [("d", 1, 2, "A long"), ("d", 2, 2, "heading"), ("d", 3, 0, "body"), ("d", 4, 0, "body"), ("d", 5, 2, "x" * 40), ("d", 6, 2, "y" * 40), ("d", 7, 3, "z"), ("e", 1, 2, "alone")]
    out = structure.merged_headings(spark.createDataFrame(rows, "doc string, n int, level int, text string"), "doc", "n", "level", "text")
    assert sorted(tuple(r) for r in out.collect()) == [("d", 1, 2, "A long heading"), ("d", 3, 0, "body"), ("d", 4, 0, "body"), ("d", 5, 2, "x" * 40), ("d", 6, 2, "y" * 40), ("d", 7, 3, "z"), ("e", 1, 2, "alone")]


def test_chunks_end_before_sections(spark):
    def chunks(starts, last, most):
        rows = spark.createDataFrame([("c", s, last) for s in starts], "chapter string, start int, last int")
        return sorted(tuple(r)[1:] for r in structure.split_at_sections(rows, "chapter", "start", "last", most).collect())

    for starts, last, most in (([1, 4, 9, 12], 20, 8), ([1], 30, 10), ([3, 5], 6, 50), ([1, 2, 3, 4, 5, 6], 6, 2), ([1, 10], 11, 10)):
        got = chunks(starts, last, most)
        assert got[0][0] == starts[0] and got[-1][1] == last and all(a[1] + 1 == b[0] for a, b in zip(got, got[1:]))
        assert all(b - a + 1 <= most + 1 for a, b in got)
    assert chunks([1, 4, 9, 12], 20, 8)[0] == (1, 8) and chunks([3, 5], 6, 50) == [(3, 6)]
