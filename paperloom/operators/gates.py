"""Quality gates over pages: title quality, stage matching, page checks, scorecards and verdicts.

A page is (deck, page, text); decks are independent, so every window and aggregate is by deck. Rules are
small tables or literal lists. Issues are one wide table (deck, page, type, tier).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: Words of action that make a title a statement.
ASSERTION_VERBS = (
    "是 有 在 成为 增长 下降 提升 降低 增加 减少 推动 促进 导致 实现 达到 超过 占据 占比 具备 "
    "提供 解决 采用 应用 需要 面临 处于 分为 包括 涉及 围绕 针对 基于 通过 利用 借助 依靠 源于 "
    "达成 完成 突破 打造 构建 建立 覆盖 引入 替代"
).split()
#: Words of description that make a title acceptable.
DESCRIPTIVE_WORDS = (
    "架构 方案 产品 平台 能力 优势 特点 背景 概述 概览 总结 展望 规划 路线 流程 模式 团队 组织 案例 指标 数据 分析 对比 评估 "
    "策略 目标 计划 预算 资源 时间 里程碑 技术 服务 功能 特性 场景 价值 成果 效果 现状 趋势 规模 份额 市场 行业 竞争 生态 "
    "体系 框架 结构 模块 层次 组件 系统 网络 运营 管理 治理 安全 合规 风险 质量 成本 收入 利润 投资 融资 估值 测算 预测 "
    "全景 总览 一览 全貌 蓝图 画像 地图"
).split()
#: Openings that say nothing by themselves.
NEUTRAL_OPENINGS = "关于 对于 概述 分析 报告 介绍 说明 讨论 审查".split()
#: Closing words of a last page, and of the last two.
CLOSING_WORDS = ("谢谢", "感谢", "Q&A", "联系", "THANK", "Thank", "END", "结束")
CLOSING_WORDS_STRUCTURE = ("谢谢", "感谢", "Q&A", "THANK", "Thank", "联系")
ERROR_TYPES = ("C1_PLACEHOLDER", "C2_EMPTY_PAGE", "C7_GARBLED")
#: Characters that don't count as a page's content.
HOLLOW = r"[ \t\r\n\f\x0B0-9.,;:!?()\[\]{}_+=*/\\|-]+"


def title_quality(title: Column, verbs: list[str] | None = None, descriptive: list[str] | None = None, openings: list[str] | None = None) -> Column:
    """strong, neutral, weak or empty; the word lists are parameters, so other languages can have theirs."""
    t = X.strip(F.coalesce(title, F.lit("")))
    opening = F.lit(False)
    for s in NEUTRAL_OPENINGS if openings is None else openings:
        opening = opening | (t.startswith(s) & (F.length(t) <= len(s) + 4))
    verb = X.any_contained(t, ASSERTION_VERBS if verbs is None else verbs)
    word = X.any_contained(t, DESCRIPTIVE_WORDS if descriptive is None else descriptive)
    return F.when(t == "", "empty").when((F.length(t) < 3) | opening, "weak").when(verb, "strong").when(word, "neutral").when(F.length(t) < 5, "weak").otherwise("neutral")


def stage_match(pages: DataFrame, stages: list[dict], keys: list[str], title: str, least: int = 3) -> DataFrame:
    """(keys, stage_id, stage_order, score): the best stage of each title, null under the least score.

    A pattern that occurs adds its weight once (keywords 10, synonyms 5); covered characters add up to 3.
    The first stage wins ties. Stages are a rule table of a few rows: one expression, no join.
    """
    rows = pages.withColumn("_low", F.lower(F.coalesce(F.col(title), F.lit(""))))
    rules = [(n, p.lower(), w) for n, s in enumerate(stages) for kind, w in (("keywords", 10), ("synonyms", 5)) for p in s.get(kind, ())]
    # how often each pattern occurs, once; then sums over each stage's part of that array
    hits = F.array(*[X.occurrences(F.col("_low"), F.lit(p)) for _, p, _ in rules]).cast("array<int>")
    table = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(w).alias("weight"), F.lit(len(p)).alias("chars")) for n, p, w in rules])
    rows = rows.withColumn("_hits", F.filter(F.zip_with(table, hits, lambda r, h: F.struct(r["stage"].alias("stage"), r["weight"].alias("weight"), (r["chars"] * h).alias("chars"))), lambda x: x["chars"] > 0))

    def scored(stage: Column) -> Column:
        own = F.filter("_hits", lambda x: x["stage"] == stage["n"])
        total = F.aggregate(own, F.struct(F.lit(0).alias("w"), F.lit(0).alias("c")), lambda t, x: F.struct((t["w"] + x["weight"]).alias("w"), (t["c"] + x["chars"]).alias("c")))
        cover = lambda t: F.when(F.length("_low") > 0, F.least(F.lit(3), F.floor(t["c"] * 10 / F.length("_low")).cast("int"))).otherwise(0)
        return F.struct(F.element_at(F.transform(F.array(total), lambda t: t["w"] + cover(t)), 1).alias("score"), (-stage["n"]).alias("negative"), stage["id"].alias("stage_id"), stage["order"].alias("stage_order"))

    every = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(s["id"]).alias("id"), F.lit(s["order"]).alias("order")) for n, s in enumerate(stages)])
    out = rows.withColumn("_b", F.array_max(F.transform(every, scored)))
    good = F.col("_b.score") >= least
    return out.select(*keys, F.when(good, F.col("_b.stage_id")).alias("stage_id"), F.when(good, F.col("_b.stage_order")).alias("stage_order"), F.when(good, F.col("_b.score")).otherwise(0).alias("score"))


def order_violations(matched: DataFrame, deck: str, page: str) -> DataFrame:
    """Matched pages whose stage comes before that of the matched page just before."""
    before = F.lag("stage_order").over(Window.partitionBy(deck).orderBy(page))
    return matched.where("stage_id is not null").withColumn("previous_order", before).where("stage_order < previous_order")


def missing_stages(matched: DataFrame, stages: list[dict], deck: str) -> DataFrame:
    """(deck, stage_id) of required stages that no page has."""
    needed = F.array(*[F.lit(s["id"]) for s in stages if s.get("required")])
    found = matched.groupBy(deck).agg(F.collect_set("stage_id").alias("found"))
    return found.select(deck, F.explode(F.array_except(needed, "found")).alias("stage_id"))


def gate_report(matched: DataFrame, stages: list[dict], deck: str, page: str, title: str, quality: Column | None = None) -> DataFrame:
    """One row a deck: pages, unmatched, weak and empty titles, missing stages, order violations, passed."""
    q = title_quality(F.col(title)) if quality is None else quality
    before = F.last("stage_order", ignorenulls=True).over(Window.partitionBy(deck).orderBy(page).rowsBetween(Window.unboundedPreceding, -1))
    rows = matched.withColumn("_q", q).withColumn("_back", F.col("stage_order") < before)
    needed = F.array(*[F.lit(s["id"]) for s in stages if s.get("required")]).cast("array<string>")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    # the window's rows are dealt by deck already
    out = rows.groupBy(deck).agg(
        F.count("*").alias("pages"), n(F.col("stage_id").isNull()).alias("unmatched"), n(F.col("_q") == "weak").alias("weak_titles"), n(F.col("_q") == "empty").alias("empty_titles"),
        F.collect_set("stage_id").alias("_found"), n(F.col("_back")).alias("violations"),
    )
    out = out.withColumn("missing", F.size(F.array_except(needed, "_found")).cast("long")).drop("_found")
    return out.select(deck, "pages", "unmatched", "weak_titles", "empty_titles", "missing", "violations").withColumn("passed", (F.col("missing") == 0) & (F.col("empty_titles") == 0))


def content_length(text: Column) -> Column:
    """Characters that are neither blanks, digits nor ASCII punctuation."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), HOLLOW, ""))


def page_checks(pages: DataFrame, deck: str, page: str, text: str, closing: tuple[str, ...] = CLOSING_WORDS) -> DataFrame:
    """Issues of single pages: placeholders left, empty pages, first and last page's content, garbled text. One pass makes an array of a page's issues, which is exploded once."""
    last = pages.groupBy(deck).agg(F.max(page).alias("_last"))
    body = F.coalesce(F.col(text), F.lit(""))
    cover = (F.col(page) == 1) & (F.length(body) < 20)
    end = (F.col(page) == F.col("_last")) & ~X.any_contained(body, closing)
    found = [("C1_PLACEHOLDER", F.size(X.placeholders(body)) > 0), ("C2_EMPTY_PAGE", content_length(body) < 10), ("C3_CONTENT_MATCH", cover | end), ("C7_GARBLED", (F.length(body) >= 5) & body.contains("\ufffd"))]
    types = F.filter(F.array(*[F.when(holds, F.lit(kind)) for kind, holds in found]), lambda x: x.isNotNull())
    return pages.join(last, deck).select(deck, F.col(page).alias("page"), F.explode(types).alias("type"), F.lit(None).cast("string").alias("tier"))


def structure_check(pages: DataFrame, deck: str, page: str, text: str, closing: tuple[str, ...] = CLOSING_WORDS_STRUCTURE) -> DataFrame:
    """One row a deck: has_cover, has_closing (in the last two pages), complete."""
    last = pages.groupBy(deck).agg(F.max(page).alias("_last"))
    rows = pages.join(last, deck)
    body = F.coalesce(F.col(text), F.lit(""))
    n = F.max("_last")
    cover = F.max(F.when(F.col(page) == 1, F.length(body)).otherwise(0))
    end = F.max(F.when((F.col(page) >= F.col("_last") - 1) & X.any_contained(body, closing), 1).otherwise(0)) == 1
    out = rows.groupBy(deck).agg(n.alias("pages"), cover.alias("_c"), end.alias("_e"))
    two = F.col("pages") >= 2
    return out.select(deck, "pages", F.when(two, F.col("_c") >= 10).otherwise(F.col("pages") > 0).alias("has_cover"), (two & F.col("_e")).alias("has_closing")).withColumn("complete", F.col("has_cover") & F.col("has_closing"))


def collapse(issues: DataFrame, deck: str, threshold: int = 10, hint: int = 15, samples: int = 5) -> DataFrame:
    """(deck, type, n, sample_pages, collapsed, hint): issues folded by type."""
    pages = F.array_sort(F.collect_list("page"))
    return issues.groupBy(deck, "type").agg(F.count("*").alias("n"), F.slice(pages, 1, samples).alias("sample_pages")).withColumn("collapsed", F.col("n") > threshold).withColumn("hint", F.col("n") > hint)


def scorecard(pages: DataFrame, issues: DataFrame, deck: str, page: str) -> DataFrame:
    """(deck, page, score, errors, critical, warnings, top_issues): 100 less 30, 15 and 3 for each."""
    kind = F.when(F.col("type").isin(*ERROR_TYPES), "e").when((F.col("type") == "C9_OUTLIER") & F.col("tier").eqNullSafe("critical"), "c").otherwise("w")
    n = lambda k: F.sum(F.when(F.col("_k") == k, 1).otherwise(0))
    found = issues.where("page is not null").withColumn("_k", kind).groupBy(deck, F.col("page").alias(page))
    found = found.agg(n("e").alias("errors"), n("c").alias("critical"), n("w").alias("warnings"), F.slice(F.array_sort(F.collect_set("type")), 1, 3).alias("top_issues"))
    out = pages.select(deck, page).join(found, [deck, page], "left").fillna(0, ["errors", "critical", "warnings"])
    score = F.greatest(F.lit(0), 100 - F.col("errors") * 30 - F.col("critical") * 15 - F.col("warnings") * 3)
    return out.select(deck, page, score.cast("long").alias("score"), "errors", "critical", "warnings", F.coalesce("top_issues", X.no_strings()).alias("top_issues"))


def conclusion(cards: DataFrame, issues: DataFrame, deck: str) -> DataFrame:
    """(deck, pages, errors, critical, warnings, grade, passed)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    pages = cards.groupBy(deck).agg(F.count("*").alias("pages"), n(F.col("score") < 50).alias("poor"))
    kinds = issues.groupBy(deck).agg(n(F.col("type").isin(*ERROR_TYPES)).alias("errors"), n((F.col("type") == "C9_OUTLIER") & F.col("tier").eqNullSafe("critical")).alias("critical"), n(~F.col("type").isin(*ERROR_TYPES, "C6_SOURCE_COVERAGE")).alias("warnings"))
    out = pages.join(kinds, deck, "left").fillna(0, ["errors", "critical", "warnings"])
    grade = F.when(F.col("errors") > 0, "needs fixing").when((F.col("critical") > 0) | (F.col("poor") > 0), "needs review").when(F.col("warnings") <= F.col("pages") * 0.3, "good").otherwise("fair")
    return out.select(deck, "pages", "errors", "critical", "warnings", grade.alias("grade"), (F.col("errors") == 0).alias("passed"))


def check_flags(issues: DataFrame, deck: str, kinds: tuple[str, ...]) -> DataFrame:
    """One boolean for each kind of check and deck."""
    return issues.groupBy(deck).agg(*[F.max(F.col("type") == k).alias(k.lower()) for k in kinds])


#: How much a font gets smaller for texts of over so many characters, and its least size.
SHRINK, LEAST_SIZE = ((80, 6), (50, 4), (30, 2), (15, 1)), 8


def fitted_size(size: Column, length: Column) -> Column:
    """A font size that shrinks as a text gets longer; texts of up to 15 characters keep theirs."""
    out = size
    for over, less in reversed(SHRINK):
        out = F.when(length > over, F.greatest(F.lit(LEAST_SIZE), size - less)).otherwise(out)
    return out


#: Characters of a text that may overflow, and of a sample; samples of a slide; letters of the languages that may be left over.
OVERFLOW, SAMPLE, SAMPLES = 100, 80, 5
LEFT_OVER = {"zh": "[一-鿿]", "ja": "[\u3040-\u309f\u30a0-\u30ff]"}


def slide_verification(slides: DataFrame, deck: str, slide: str, texts: str, background: str, expected: str | None = None, lang: str = "zh") -> DataFrame:
    """A row a slide: is its background (a colour, null without one) the expected one, or any if none is; how many of its texts still have letters of the language, with samples; how many are longer than a box may hold; and whether all is well."""
    found = F.filter(F.transform(F.coalesce(F.col(texts), X.no_strings()), X.strip), lambda x: x != "")
    left, long = F.filter(found, lambda x: x.rlike(LEFT_OVER[lang])), F.filter(found, lambda x: F.length(x) > OVERFLOW)
    shown = F.upper(background)
    ok = F.coalesce(shown == expected.upper(), F.lit(False)) if expected else F.lit(True)
    rows = slides.select(deck, slide, shown.alias("background"), ok.alias("background_ok"), F.size(left).cast("long").alias("left_over"), F.transform(F.slice(left, 1, SAMPLES), lambda x: F.left(x, F.lit(SAMPLE))).alias("samples"), F.size(long).cast("long").alias("long_texts"))
    return rows.withColumn("passed", F.col("background_ok") & (F.col("left_over") == 0) & (F.col("long_texts") == 0))


def deck_verification(verified: DataFrame, deck: str) -> DataFrame:
    """(deck, slides, background_ok, translation_ok, overflow_ok, passed) of :func:`slide_verification`: how many slides pass each check, and whether all pass all."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return verified.groupBy(deck).agg(F.count("*").alias("slides"), n(F.col("background_ok")).alias("background_ok"), n(F.col("left_over") == 0).alias("translation_ok"), n(F.col("long_texts") == 0).alias("overflow_ok"), F.bool_and("passed").alias("passed"))


def keyword_coverage(source: DataFrame, order: str, tokens: Column, pages: DataFrame, page_tokens: Column, most: int = 20) -> DataFrame:
    """(place, tok, covered): the commonest tokens of a source, the first met before others as common, and whether any page has them."""
    each = source.select(order, F.posexplode(tokens).alias("_pos", "tok"))
    top = each.groupBy("tok").agg(F.count("*").alias("n"), F.min(F.struct(order, "_pos")).alias("_first")).orderBy(F.desc("n"), "_first").limit(most)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_first")))  # ``most`` rows
    have = pages.select(F.explode(page_tokens).alias("tok")).distinct().withColumn("_has", F.lit(True))
    return top.join(have, "tok", "left").select("place", "tok", F.coalesce("_has", F.lit(False)).alias("covered"))


def coverage_summary(covered: DataFrame, shown: int = 10) -> DataFrame:
    """One row: covered, total, the first missing tokens, and the rate of coverage to two places (null without tokens)."""
    n = F.sum(F.when(F.col("covered"), 1).otherwise(0))
    missing = F.array_sort(F.collect_list(F.when(~F.col("covered"), F.struct("place", "tok"))))
    return covered.agg(n.alias("covered"), F.count("*").alias("total"), F.transform(F.slice(missing, 1, shown), lambda x: x["tok"]).alias("missing"), F.round(n / F.count("*"), 2).alias("coverage_rate"))


def project_validation(projects: DataFrame) -> DataFrame:
    """A row for each format, and one for all (a null format): projects, valid ones (no error and no warning), with errors, with warnings only, without readme, without specification, with faults of drawings.

    ``projects``: (format, errors, warnings, drawing_warnings, has_readme, has_spec), the first three numbers.
    """
    clean = (F.col("errors") == 0) & (F.col("warnings") == 0) & (F.col("drawing_warnings") == 0)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    sets = projects.groupingSets([[F.col("format")], []], "format")
    return sets.agg(
        F.count("*").alias("projects"), n(clean).alias("valid"), n(F.col("errors") > 0).alias("has_errors"), n(~clean & (F.col("errors") == 0)).alias("has_warnings"),
        n(~F.col("has_readme")).alias("missing_readme"), n(~F.col("has_spec")).alias("missing_spec"), n(F.col("drawing_warnings") > 0).alias("drawing_issues"), (F.grouping_id("format") == 1).alias("all_formats"),
    )
