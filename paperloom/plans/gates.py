"""Queries of quality gates; decks are conversations, pages their turns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import drawings as D
from ..operators import gates as G
from ..operators import registry as R
from ._registry import query

#: A storyline of our own for the synthetic tables' words.
STAGES = [
    {"id": "opening", "order": 1, "required": True, "keywords": ["the"], "synonyms": ["and"]},
    {"id": "middle", "order": 2, "required": False, "keywords": ["of "], "synonyms": ["en", "tion"]},
    {"id": "closing", "order": 3, "required": True, "keywords": ["der"], "synonyms": ["que", "is"]},
]
_CLOSING = ("the ", "Thank", "der ")


#: Faults that pages can have, put on some of the turns, as the tables' own texts have none.
_FAULTS = {3: "text || ' {{TITLE}}'", 5: "' 12 . '", 7: "text || chr(65533)", 9: "''"}


def _pages(t):
    part, text = F.expr("(conv_id * 31 + turn) % 17"), F.col("text")
    text = F.when(part == 3, F.concat(text, F.lit(" {{TITLE}}"))).when(part == 5, " 12 . ").when(part == 7, F.concat(text, F.lit("\ufffd"))).when(part == 9, "").otherwise(text)
    pages = t("conversations").select(F.col("conv_id").alias("deck"), (F.col("turn") + 1).alias("page"), text.alias("text"))
    return pages.withColumn("title", F.substring_index("text", "\n", 1))


_TURNS = f"(SELECT conv_id AS deck, turn + 1 AS page, CASE (conv_id * 31 + turn) % 17 {' '.join(f'WHEN {k} THEN {v}' for k, v in _FAULTS.items())} ELSE text END AS text FROM conversations)"
_PAGES = f"(SELECT *, string_split(text, chr(10))[1] AS title FROM {_TURNS})"


def _has(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


_T = r"regexp_replace(title, '^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$', '', 'g')"
_VERBS, _WORDS, _OPEN = ["is ", "are "], ["the", "der"], ["It", "Un"]
_QUALITY = f"CASE WHEN {_T} = '' THEN 'empty' WHEN length({_T}) < 3 OR " + " OR ".join(f"(starts_with({_T}, '{s}') AND length({_T}) <= {len(s) + 4})" for s in _OPEN) + f" THEN 'weak' WHEN {_has(_T, _VERBS)} THEN 'strong' WHEN {_has(_T, _WORDS)} THEN 'neutral' WHEN length({_T}) < 5 THEN 'weak' ELSE 'neutral' END"


def _quality():
    return G.title_quality(F.col("title"), _VERBS, _WORDS, _OPEN)


@query(f"SELECT deck, page, {_QUALITY} AS quality FROM {_PAGES}")
def title_quality(t):
    return _pages(t).select("deck", "page", _quality().alias("quality"))


def _stage_sql() -> str:
    scores = []
    for s in STAGES:
        hits = lambda p: f"((length(low) - length(replace(low, '{p}', ''))) // {len(p)})"
        pats = [(p, 10) for p in s["keywords"]] + [(p, 5) for p in s["synonyms"]]
        weight = " + ".join(f"CASE WHEN {hits(p)} > 0 THEN {w} ELSE 0 END" for p, w in pats)
        chars = " + ".join(f"{hits(p)} * {len(p)}" for p, _ in pats)
        scores.append(f"({weight} + CASE WHEN length(low) > 0 THEN least(3, CAST(floor(({chars}) * 10 / length(low)) AS INT)) ELSE 0 END)")
    a, b, c = scores
    return f"""(SELECT deck, page, title, CASE WHEN best >= 3 THEN CASE WHEN a = best THEN 'opening' WHEN b = best THEN 'middle' ELSE 'closing' END END AS stage_id,
        CASE WHEN best >= 3 THEN CASE WHEN a = best THEN 1 WHEN b = best THEN 2 ELSE 3 END END AS stage_order, CASE WHEN best >= 3 THEN best ELSE 0 END AS score
        FROM (SELECT *, greatest(a, b, c) AS best FROM (SELECT *, {a} AS a, {b} AS b, {c} AS c FROM (SELECT *, lower(title) AS low FROM {_PAGES}))))"""


def _matched(t):
    p = _pages(t)
    return G.stage_match(p, STAGES, ["deck", "page", "title"], "title")


@query(f"SELECT deck, page, stage_id, score FROM {_stage_sql()}")
def stage_match(t):
    return _matched(t).select("deck", "page", "stage_id", "score")


_VIOL = f"(SELECT * FROM (SELECT deck, page, stage_id, stage_order, lag(stage_order) OVER (PARTITION BY deck ORDER BY page) AS previous_order FROM {_stage_sql()} WHERE stage_id IS NOT NULL) WHERE stage_order < previous_order)"


@query(f"SELECT deck, page, stage_id, previous_order FROM {_VIOL}")
def stage_order_violation(t):
    return G.order_violations(_matched(t), "deck", "page").select("deck", "page", "stage_id", "previous_order")


_MISS = f"(SELECT d.deck, r.stage_id FROM (SELECT DISTINCT deck FROM {_PAGES}) d CROSS JOIN (SELECT unnest(['opening', 'closing']) AS stage_id) r WHERE NOT EXISTS (SELECT 1 FROM {_stage_sql()} m WHERE m.deck = d.deck AND m.stage_id = r.stage_id))"


@query(f"SELECT deck, stage_id FROM {_MISS}")
def missing_stages(t):
    return G.missing_stages(_matched(t), STAGES, "deck")


_GATE = f"""(SELECT b.*, coalesce(m.missing, 0) AS missing, coalesce(v.violations, 0) AS violations, coalesce(m.missing, 0) = 0 AND empty_titles = 0 AS passed FROM
    (SELECT deck, count(*) AS pages, count(*) FILTER (stage_id IS NULL) AS unmatched, count(*) FILTER ({_QUALITY} = 'weak') AS weak_titles, count(*) FILTER ({_QUALITY} = 'empty') AS empty_titles FROM {_stage_sql()} GROUP BY deck) b
    LEFT JOIN (SELECT deck, count(*) AS missing FROM {_MISS} GROUP BY 1) m USING (deck) LEFT JOIN (SELECT deck, count(*) AS violations FROM {_VIOL} GROUP BY 1) v USING (deck))"""


def _gate(t):
    return G.gate_report(_matched(t), STAGES, "deck", "page", "title", _quality())


@query(f"SELECT * FROM {_GATE}")
def gate_report(t):
    return _gate(t)


@query(f"SELECT deck, page, length(regexp_replace(text, '{G.HOLLOW}', '', 'g')) AS chars FROM {_PAGES} WHERE length(regexp_replace(text, '{G.HOLLOW}', '', 'g')) < 10")
def empty_page(t):
    n = G.content_length(F.col("text"))
    return _pages(t).select("deck", "page", n.cast("long").alias("chars")).where("chars < 10")


_LASTED = f"(SELECT *, max(page) OVER (PARTITION BY deck) AS last FROM {_PAGES})"
_ISSUES = f"""(SELECT deck, page, 'C1_PLACEHOLDER' AS type FROM {_LASTED} WHERE regexp_matches(text, '{X.PLACEHOLDER}') UNION ALL
    SELECT deck, page, 'C2_EMPTY_PAGE' FROM {_LASTED} WHERE length(regexp_replace(text, '{G.HOLLOW}', '', 'g')) < 10 UNION ALL
    SELECT deck, page, 'C3_CONTENT_MATCH' FROM {_LASTED} WHERE (page = 1 AND length(text) < 20) OR (page = last AND NOT {_has("text", _CLOSING)}) UNION ALL
    SELECT deck, page, 'C7_GARBLED' FROM {_LASTED} WHERE length(text) >= 5 AND contains(text, chr(65533)))"""


def _issues(t):
    return G.page_checks(_pages(t), "deck", "page", "text", _CLOSING)


@query(f"SELECT deck, page, type FROM {_ISSUES}")
def page_checks(t):
    return _issues(t).select("deck", "page", "type")


@query(f"SELECT deck, page FROM {_ISSUES} WHERE type = 'C3_CONTENT_MATCH'")
def role_content(t):
    return _issues(t).where("type = 'C3_CONTENT_MATCH'").select("deck", "page")


@query(
    f"""SELECT deck, pages, cover AS has_cover, pages >= 2 AND closing AS has_closing, cover AND pages >= 2 AND closing AS complete FROM (SELECT deck, max(last) AS pages,
    CASE WHEN max(last) >= 2 THEN max(CASE WHEN page = 1 THEN length(text) ELSE 0 END) >= 10 ELSE true END AS cover, bool_or(page >= last - 1 AND {_has("text", _CLOSING)}) AS closing FROM {_LASTED} GROUP BY deck)"""
)
def structure_complete(t):
    return G.structure_check(_pages(t), "deck", "page", "text", _CLOSING)


@query(f"SELECT deck, type, count(*) AS n, array_to_string(list_sort(list(page))[1:5], ',') AS sample_pages, count(*) > 10 AS collapsed, count(*) > 15 AS hint FROM {_ISSUES} GROUP BY deck, type")
def issue_collapse(t):
    return G.collapse(_issues(t), "deck").withColumn("sample_pages", F.array_join("sample_pages", ","))


_CARDS = f"""(SELECT p.deck, p.page, greatest(0, 100 - coalesce(e, 0) * 30 - coalesce(w, 0) * 3) AS score, coalesce(e, 0) AS errors, 0 AS critical, coalesce(w, 0) AS warnings, coalesce(top, []) AS top_issues FROM {_PAGES} p
    LEFT JOIN (SELECT deck, page, count(*) FILTER (type <> 'C3_CONTENT_MATCH') AS e, count(*) FILTER (type = 'C3_CONTENT_MATCH') AS w, list_sort(list(DISTINCT type))[1:3] AS top FROM {_ISSUES} GROUP BY 1, 2) i USING (deck, page))"""


def _cards(t):
    return G.scorecard(_pages(t), _issues(t), "deck", "page")


@query(f"SELECT * REPLACE (array_to_string(top_issues, ',') AS top_issues) FROM {_CARDS}")
def page_scorecard(t):
    return _cards(t).withColumn("top_issues", F.array_join("top_issues", ","))


_CONCLUSION = f"""(SELECT c.deck, pages, coalesce(e, 0) AS errors, 0 AS critical, coalesce(w, 0) AS warnings, CASE WHEN coalesce(e, 0) > 0 THEN 'needs fixing' WHEN poor > 0 THEN 'needs review' WHEN coalesce(w, 0) <= pages * 0.3 THEN 'good' ELSE 'fair' END AS grade, coalesce(e, 0) = 0 AS passed
    FROM (SELECT deck, count(*) AS pages, count(*) FILTER (score < 50) AS poor FROM {_CARDS} GROUP BY 1) c LEFT JOIN (SELECT deck, count(*) FILTER (type <> 'C3_CONTENT_MATCH') AS e, count(*) FILTER (type = 'C3_CONTENT_MATCH') AS w FROM {_ISSUES} GROUP BY 1) USING (deck))"""


@query(f"SELECT * FROM {_CONCLUSION}")
def deck_conclusion(t):
    return G.conclusion(_cards(t), _issues(t), "deck")


@query(f"SELECT deck, bool_or(type = 'C1_PLACEHOLDER') AS c1_placeholder, bool_or(type = 'C2_EMPTY_PAGE') AS c2_empty_page, bool_or(type = 'C3_CONTENT_MATCH') AS c3_content_match FROM {_ISSUES} GROUP BY deck")
def check_flags(t):
    return G.check_flags(_issues(t), "deck", ("C1_PLACEHOLDER", "C2_EMPTY_PAGE", "C3_CONTENT_MATCH"))


@query(f"SELECT c.deck, c.passed AS content_passed, g.passed AS gate_passed, c.passed AND g.passed AS passed FROM {_CONCLUSION} c JOIN {_GATE} g USING (deck)")
def overall_verdict(t):
    content = G.conclusion(_cards(t), _issues(t), "deck").select("deck", F.col("passed").alias("content_passed"))
    return content.join(_gate(t).select("deck", F.col("passed").alias("gate_passed")), "deck").withColumn("passed", F.col("content_passed") & F.col("gate_passed"))


#: Fragments that pages get as drawings: faults of every rule, fills, fonts, sizes and images, by the page's number.
_FRAGMENTS = [
    '<clipPath id="c1"/><rect clip-path="url(#c1)" fill="#ab12cd"/>', "<clipPath id='c2'/><image href='img/p3.png' clip-path='url(#c3)'/><text>p3 © Brand#11</text>", '<svg data-pptx-crop="1" clip-path="url(#c4)"><clipPath id="c4"/></svg><image href="../img/p4.png"/>',
    '<line marker-end="url(#m)" stroke="#000000"/>', '<pattern id="x"/><pattern data-pptx-pattern="plaid"/>', '<pattern data-pptx-pattern="stripes"/><set x="1"/>', '<symbol id="s"/><use href="#s"/>',
    '<text font-family="Comic Sans MS" font-size="30px" fill="#AB12CD">x</text>', "<text font-family='Inter, Arial, sans-serif' font-size='900'>x</text>", '<foreignObject/><g x="1" opacity="0.5"/>', '<image href="data:image/png;base64,AA"/><image href="p5.png"/>', '<text font-size="18">y</text>', "",
]
_HEADS = ['<svg viewBox="0 0 1280 720" width="1280" height="720">', '<svg viewBox="0 0 1280 720" width="640" height="720">', '<svg viewBox="10 0 1280 720">', "<svg>", '<svg viewBox="0 0 800 600">']
#: Of the pages' own markup its text only, so that drawings without a fault are among them.
_DRAWINGS = f"""(SELECT page_id, [{", ".join(f"'{x}'" for x in _HEADS)}][CAST(page_id % 5 AS INT) + 1] || [{", ".join("'" + x.replace("'", "''") + "'" for x in _FRAGMENTS)}][CAST(page_id % 13 AS INT) + 1]
    || CASE WHEN page_id % 7 = 0 THEN html ELSE '<text>' || left(regexp_replace(html, '<[^>]*>', '', 'g'), 60 + CAST(page_id % 50 AS INT)) || '</text>' END || '</svg>' AS svg FROM pages)"""


def _drawings(t):
    pick = lambda values, n: F.element_at(F.array(*[F.lit(x) for x in values]), (F.col("page_id") % n + 1).cast("int"))
    text = F.concat(F.lit("<text>"), F.left(F.regexp_replace("html", "<[^>]*>", ""), (60 + F.col("page_id") % 50).cast("int")), F.lit("</text>"))
    return t("pages").select("page_id", F.concat(pick(_HEADS, 5), pick(_FRAGMENTS, 13), F.when(F.col("page_id") % 7 == 0, F.col("html")).otherwise(text), F.lit("</svg>")).alias("svg"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rules_sql() -> list[tuple[str, str, str]]:
    has = lambda p, c="svg": f"regexp_matches({c}, {_quoted(p)})"
    value = r"""\s*=\s*(?:"([^"]*)"|'([^']*)')"""
    first = lambda name, of="tags": f"""list_filter(list_transform({of}, lambda g: coalesce(nullif(regexp_extract(g, {_quoted(r"[ \t\r\n]" + name + value)}, 1), ''), regexp_extract(g, {_quoted(r"[ \t\r\n]" + name + value)}, 2))), lambda v: v <> '')"""
    clipped = f"list_filter(tags, lambda g: {has(r'[ \t\r\n]clip-path\s*=', 'g')})"
    stack = r"(?i)font-family[:\s=]*[\"']([^\"']+)[\"']"
    named = "list_filter(list_transform(string_split(f, ','), lambda p: lower(regexp_replace(trim(p), '^[\"'']+|[\"'']+$', '', 'g'))), lambda p: p <> '' AND p NOT IN (" + ", ".join(map(_quoted, D.GENERIC_FONTS)) + "))"
    safe, fills = ", ".join(map(_quoted, D.SAFE_FONTS)), ", ".join(map(_quoted, D.PATTERN_FILLS))
    fill = r"""list_transform(list_filter(tags, lambda g: regexp_matches(g, '(?i)^<pattern\b')), lambda g: coalesce(nullif(regexp_extract(g, 'data-pptx-pattern\s*=\s*"([^"]*)"', 1), ''), ''))"""
    side = lambda name: f"list_filter({first(name)}, lambda v: regexp_full_match(v, '[0-9]+'))[1]"
    return [
        *((n, "error", has(p, "low")) for n, p in D.FORBIDDEN.items()), *((n, "error", has(p)) for n, p in D.FORBIDDEN_CASED.items()),
        ("id_with_style", "error", "contains(low, '<style') AND " + has(r"\bid\s*=")), ("symbol_with_use", "error", "contains(low, '<symbol') AND " + has(r"<use\b", "low")),
        ("marker_without_definition", "error", has(r"""[ \t\r\n]marker-(?:start|end)\s*=\s*["']url\(#""") + " AND NOT contains(low, '<marker')"),
        ("clip_on_shape", "error", f"contains(low, '<clippath') AND len(list_filter({clipped}, lambda g: NOT regexp_matches(g, '(?i)^<image\\b') AND NOT (regexp_matches(g, '(?i)^<svg\\b') AND regexp_matches(g, 'data-pptx-crop\\s*=\\s*\"1\"')))) > 0"),
        ("clip_without_definition", "error", f"contains(low, '<clippath') AND len(list_filter({first('clip-path')}, lambda v: NOT list_contains({first('id')}, regexp_extract(v, '^url\\(#(.+)\\)$', 1)))) > 0"),
        ("viewbox_missing", "error", f"len({first('viewBox')}) = 0"), ("viewbox_unusual", "warning", f"len({first('viewBox')}) > 0 AND NOT regexp_matches({first('viewBox')}[1], '^0 0 [0-9]+ [0-9]+')"),
        ("viewbox_mismatch", "error", f"len({first('viewBox')}) > 0 AND {first('viewBox')}[1] <> '0 0 1280 720'"),
        ("size_mismatch", "warning", f"coalesce(({side('width')} <> string_split({first('viewBox')}[1], ' ')[3] OR {side('height')} <> string_split({first('viewBox')}[1], ' ')[4]) AND {side('width')} IS NOT NULL AND {side('height')} IS NOT NULL, false)"),
        ("long_text", "warning", has("<text[^>]*>[^<]{100,}</text>")),
        ("unsafe_font", "warning", f"len(list_filter(regexp_extract_all(svg, {_quoted(stack)}, 1), lambda f: len({named}) > 0 AND {named}[-1] NOT IN ({safe}))) > 0"),
        ("pattern_unnamed", "warning", f"list_contains({fill}, '')"), ("pattern_unknown", "error", f"len(list_filter({fill}, lambda v: v <> '' AND v NOT IN ({fills}))) > 0"),
    ]


_HITS = f"""(SELECT page_id, unnest(list_filter([{", ".join(f"CASE WHEN {p} THEN {{'rule': '{n}', 'severity': '{v}'}} END" for n, v, p in _rules_sql())}], lambda h: h IS NOT NULL)) AS h
    FROM (SELECT *, lower(svg) AS low, regexp_extract_all(svg, '<[A-Za-z][^>]*>') AS tags FROM {_DRAWINGS}))"""


def _rules():
    return D.static_rules(F.col("svg"), F.lit("0 0 1280 720"))


@query(f"SELECT page_id, h.rule AS rule, h.severity AS severity FROM {_HITS}")
def static_rules(t):
    return D.rule_hits(_drawings(t), "page_id", _rules())


@query(
    f"""WITH w AS (SELECT page_id, CASE WHEN bool_or(h.severity = 'error') THEN 'errors' WHEN count(h) > 0 THEN 'warnings' ELSE 'passed' END AS result FROM pages LEFT JOIN {_HITS} USING (page_id) GROUP BY page_id)
    SELECT 'total' AS kind, 'drawings' AS name, count(*) AS n, 100 AS percent FROM w UNION ALL SELECT 'result', result, count(*), CAST(floor(count(*) * 100 / (SELECT count(*) FROM w)) AS INT) FROM w GROUP BY result
    UNION ALL SELECT 'category', CASE {" ".join(f"WHEN h.rule = '{r}' THEN '{c}'" for r, c in D.CATEGORIES.items())} ELSE 'Other' END, count(*), NULL FROM {_HITS} WHERE h.severity = 'error' GROUP BY 2"""
)
def drawing_report(t):
    return D.check_report(_drawings(t), _rules())


_LOCK = (["#000000", "#fff"], ["Inter, Arial, sans-serif"], ["24"], 18.0)


@query(
    f"""SELECT kind, value, count(DISTINCT page_id) AS files FROM (SELECT page_id, 'color' AS kind, unnest(list_distinct(list_transform(regexp_extract_all(svg, '\\b(?:fill|stroke|stop-color)\\s*=\\s*["''](#[0-9A-Fa-f]{{3,8}})["'']', 1), lambda v: upper(v)))) AS value FROM {_DRAWINGS}
    UNION ALL SELECT page_id, 'font', unnest(list_distinct(regexp_extract_all(svg, 'font-family\\s*=\\s*["'']([^"'']+)["'']', 1))) FROM {_DRAWINGS}
    UNION ALL SELECT page_id, 'size', unnest(list_distinct(list_transform(regexp_extract_all(svg, 'font-size\\s*=\\s*["'']([^"'']+)["'']', 1), lambda v: regexp_replace(v, 'px$', '')))) FROM {_DRAWINGS})
    WHERE NOT (kind = 'color' AND value IN ('#000000', '#FFF')) AND NOT (kind = 'font' AND value = 'Inter, Arial, sans-serif') AND NOT (kind = 'size' AND (value = '24' OR coalesce(TRY_CAST(value AS DOUBLE) / 18 BETWEEN 0.5 AND 5, false))) GROUP BY ALL"""
)
def lock_drift(t):
    return D.lock_drift(_drawings(t), "page_id", "svg", *_LOCK)


_ASSETS = "SELECT 'p' || p_partkey || '.png' AS filename, '© ' || p_brand AS credit FROM part WHERE p_partkey % 4 <> 1"


@query(f"SELECT page_id, filename FROM (SELECT page_id, svg, unnest(list_distinct(list_transform(regexp_extract_all(svg, '<image\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda h: list_last(string_split(h, '/'))))) AS filename FROM {_DRAWINGS}) JOIN ({_ASSETS}) USING (filename) WHERE NOT contains(svg, credit)")
def missing_attribution(t):
    assets = t("part").where("p_partkey % 4 != 1").select(F.concat(F.lit("p"), "p_partkey", F.lit(".png")).alias("filename"), F.concat(F.lit("© "), "p_brand").alias("credit"))
    return D.without_credit(_drawings(t), "page_id", "svg", assets)


_SLIDES = "(SELECT deck, page, list_filter(list_transform(string_split(text || CASE WHEN (deck + page) % 5 = 0 THEN chr(10) || '还有 text' ELSE '' END, chr(10)), lambda x: regexp_replace(x, '^[ \\t\\r\\n\\f\\x0B]+|[ \\t\\r\\n\\f\\x0B]+$', '', 'g')), lambda x: x <> '') AS texts, ['000000', 'ffffff', NULL, '00000A'][CAST(page % 4 AS INT) + 1] AS background FROM {})"


@query(
    f"""SELECT deck, count(*) AS slides, count(*) FILTER (b) AS background_ok, count(*) FILTER (n = 0) AS translation_ok, count(*) FILTER (k = 0) AS overflow_ok, bool_and(b AND n = 0 AND k = 0) AS passed FROM
    (SELECT deck, coalesce(upper(background) = '00000A', false) AS b, len(list_filter(texts, lambda x: regexp_matches(x, '[一-鿿]'))) AS n, len(list_filter(texts, lambda x: length(x) > 100)) AS k FROM {_SLIDES.format(_PAGES)}) GROUP BY deck"""
)
def deck_verification(t):
    """Turns as slides, their lines as texts, some of them in another language, on four backgrounds."""
    pages = _pages(t).withColumn("text", F.concat("text", F.when((F.col("deck") + F.col("page")) % 5 == 0, "\n还有 text").otherwise("")))
    ground = F.element_at(F.array(F.lit("000000"), F.lit("ffffff"), F.lit(None), F.lit("00000A")), (F.col("page") % 4 + 1).cast("int"))
    slides = pages.select("deck", "page", F.split("text", "\n").alias("texts"), ground.alias("background"))
    return G.deck_verification(G.slide_verification(slides, "deck", "page", "texts", "background", "00000a"), "deck")


@query("SELECT p_partkey, CASE WHEN n > 80 THEN greatest(8, p_size - 6) WHEN n > 50 THEN greatest(8, p_size - 4) WHEN n > 30 THEN greatest(8, p_size - 2) WHEN n > 15 THEN greatest(8, p_size - 1) ELSE p_size END AS size FROM (SELECT *, length(repeat(p_name || p_type || p_brand, CAST(p_partkey % 4 AS INT))) AS n FROM part)")
def font_shrink(t):
    text = F.repeat(F.concat("p_name", "p_type", "p_brand"), (F.col("p_partkey") % 4).cast("int"))
    return t("part").select("p_partkey", G.fitted_size(F.col("p_size"), F.length(text)).alias("size"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)div([^0-9A-Za-z]|$)')) + len(regexp_extract_all(html, '(?i)[.]example([^0-9A-Za-z]|$)')) AS n, md5(regexp_replace(regexp_replace(html, '(?i)div([^0-9A-Za-z]|$)', 'sec$1\\1', 'g'), '(?i)[.]example([^0-9A-Za-z]|$)', '.test\\1', 'g')) AS after FROM pages")
def bulk_replacement(t):
    return D.replaced(t("pages"), "page_id", "html", {"DIV": "sec$1", ".example": ".test"}).select("page_id", F.col("n").cast("long").alias("n"), F.md5("html").alias("after"))


_OWN_ISSUES = _ISSUES.replace(_has("text", _CLOSING), _has("text", G.CLOSING_WORDS))
_CHECKS = f"""{_OWN_ISSUES[:-1]} UNION ALL SELECT deck, page, 'C5_CONTINUITY' FROM (SELECT deck, page, lag(page) OVER (PARTITION BY deck ORDER BY page) AS before FROM {_PAGES}) WHERE page <> before + 1)"""


@query(
    f"""SELECT deck, CAST(page AS BIGINT) AS page, type, CAST(NULL AS VARCHAR) AS tier, CASE WHEN type IN ('C1_PLACEHOLDER', 'C2_EMPTY_PAGE', 'C7_GARBLED') THEN 'error' ELSE 'warning' END AS severity FROM {_CHECKS}
    UNION ALL SELECT deck, NULL, 'C8_STRUCTURE', CASE WHEN cover AND pages >= 2 AND closing THEN 'complete' ELSE 'incomplete' END, 'warning' FROM (SELECT deck, max(last) AS pages,
        CASE WHEN max(last) >= 2 THEN max(CASE WHEN page = 1 THEN length(text) ELSE 0 END) >= 10 ELSE true END AS cover, bool_or(page >= last - 1 AND {_has("text", G.CLOSING_WORDS_STRUCTURE)}) AS closing FROM {_LASTED} GROUP BY deck)"""
)
def deck_checks(t):
    """The checks of a deck's pages together, of which SQL can say; the others are in the unit tests."""
    return R.run_checks(_pages(t), names=["C1_PLACEHOLDER", "C2_EMPTY_PAGE", "C3_CONTENT_MATCH", "C5_CONTINUITY", "C7_GARBLED", "C8_STRUCTURE"])
