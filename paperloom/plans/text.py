"""Queries of text features over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import joins as J
from ._registry import query

# blanks, as DuckDB's patterns name them
_B = r"[ \t\r\n\f\x0B]"


def _strip(s: str) -> str:
    return f"regexp_replace({s}, '^{_B}+|{_B}+$', '', 'g')"


@query(r"SELECT page_id, array_to_string(list_filter(regexp_extract_all(html, '<p[^>]*>([^<]*)</p>', 1), lambda x: " + _strip("x") + " <> ''), ' ') AS body FROM pages")
def text_runs(t):
    return t("pages").select("page_id", X.text_runs(F.col("html"), "p").alias("body"))


@query(
    rf"""SELECT doc_id, len(list_distinct(k)) AS n_keywords, md5(array_to_string(list_sort(list_distinct(k)), ' ')) AS keywords FROM (SELECT doc_id, list_filter(list_transform(string_split(text, ' '), lambda x: {_strip("x")}),
    lambda x: length(x) BETWEEN 2 AND 30 AND NOT regexp_full_match(x, '[0-9 .,;:!?()\[\]{{}}_+=*/\\|%-]+')) AS k FROM documents)"""
)
def keyword_runs(t):
    # a column of its own, which two results read
    found = t("documents").select("doc_id", X.keywords(F.split("text", " ")).alias("k"))
    return found.select("doc_id", F.size("k").cast("long").alias("n_keywords"), F.md5(F.array_join(F.sort_array("k"), " ")).alias("keywords"))


@query(
    r"""SELECT doc_id, len(k) AS n_tokens, md5(array_to_string(list_sort(k), ' ')) AS tokens FROM (SELECT doc_id, list_distinct(list_transform(list_concat(list_concat(runs, windows), list_concat(words, digits)), lambda x: lower(x))) AS k
    FROM (SELECT *, flatten(list_transform(list_filter(runs, lambda r: length(r) >= 4), lambda r: flatten(list_transform([2, 3, 4], lambda n: list_transform(range(1, length(r) - n + 2), lambda i: substr(r, i, n)))))) AS windows
    FROM (SELECT doc_id, regexp_extract_all(text, '[一-鿿]+') AS runs, list_filter(regexp_extract_all(text, '[\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-Z]{2,30}')) AS words, regexp_extract_all(text, '\p{Nd}+') AS digits FROM documents)))"""
)
def search_token_sets(t):
    # a column of its own, which two results read
    found = t("documents").select("doc_id", X.search_tokens(F.col("text")).alias("k"))
    return found.select("doc_id", F.size("k").cast("long").alias("n_tokens"), F.md5(F.array_join(F.sort_array("k"), " ")).alias("tokens"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS n_tokens, array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+')[1:10], ' ') AS head FROM documents")
def content_token_bags(t):
    tokens = X.content_tokens(F.col("text"))
    return t("documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(F.slice(tokens, 1, 10), " ").alias("head"))


@query(r"SELECT item_id, array_to_string(list_filter(string_split_regex(lower(text), '[ \t\r\n,，、]+'), lambda x: x <> ''), ' ') AS terms FROM benchmark")
def query_term_split(t):
    return t("benchmark").select("item_id", F.array_join(X.query_terms(F.col("text")), " ").alias("terms"))


@query(
    r"""SELECT doc_id, CASE WHEN length(w) > 1000 THEN left(text, 800) ELSE w END AS embed_text FROM (SELECT doc_id, text,
    concat_ws(' ', left(string_split(text, chr(10))[1], 40), array_to_string(string_split(lower(text), ' ')[1:3], ' '), text) AS w FROM documents)"""
)
def embed_text_compose(t):
    title, words = F.left(F.element_at(F.split("text", "\n"), 1), F.lit(40)), F.slice(F.split(F.lower("text"), " "), 1, 3)
    return t("documents").select("doc_id", X.embedding_text(title, words, F.col("text")).alias("embed_text"))


@query(
    """SELECT doc_id, (CASE WHEN s > 1 THEN '...' ELSE '' END) || substr(text, s, e - s) || (CASE WHEN e <= length(text) THEN '...' ELSE '' END) AS preview
    FROM (SELECT doc_id, text, greatest(coalesce(p, 1) - 30, 1) AS s, least(coalesce(p, 1) + 120, length(text) + 1) AS e
    FROM (SELECT doc_id, text, list_min(list_filter([instr(lower(text), 'license'), instr(lower(text), 'stupid'), instr(lower(text), 'the ')], lambda x: x > 0)) AS p FROM documents))"""
)
def preview_window(t):
    return t("documents").select("doc_id", X.preview(F.col("text"), ["license", "stupid", "the "]).alias("preview"))


@query(rf"SELECT doc_id, left(trim(regexp_replace(text, '{_B}+', ' ', 'g')), 512) AS norm FROM documents")
def normalize_text(t):
    return t("documents").select("doc_id", X.normalized(F.col("text")).alias("norm"))


@query(
    """SELECT doc_id, array_to_string(list_sort(list_distinct(list_concat([lower(lang)], list_filter(string_split_regex(lower(source), '[^a-z0-9]+'), lambda x: length(x) >= 2),
    list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) BETWEEN 3 AND 20)))), ' ') AS tags FROM documents"""
)
def search_tag_sets(t):
    return t("documents").select("doc_id", F.array_join(X.search_tags(F.col("lang"), F.col("source"), F.col("text")), " ").alias("tags"))


@query("SELECT doc_id, coalesce(nullif(concat_ws(' | ', nullif(left(source, 80), ''), nullif(left(text, 120), '')), ''), lang) AS hint FROM documents")
def description_hints(t):
    return t("documents").select("doc_id", X.description_hint(F.col("source"), F.col("text"), F.col("lang")).alias("hint"))


@query(f"SELECT doc_id, CASE WHEN length(l) > 5 THEN left(l, 80) END AS title FROM (SELECT doc_id, {_strip('string_split(text, chr(10))[1]')} AS l FROM documents)")
def first_line_titles(t):
    return t("documents").select("doc_id", X.first_line_title(F.col("text")).alias("title"))


#: Texts as files' names: the first line, with folders and endings for some.
_FILE = "CASE doc_id % 5 WHEN 0 THEN 'a/b.c/' || l || '.pptx' WHEN 1 THEN '  ' || l || '! ' WHEN 2 THEN '图_' || l || '-x.tar.gz' WHEN 3 THEN '***' ELSE l END"


@query(
    f"""SELECT doc_id, coalesce(nullif(left(regexp_replace(regexp_replace(regexp_replace(list_last(string_split(regexp_replace({_FILE}, '/+$', ''), '/')), '(.)\\.[^.]+$', '\\1'), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g'), 30), ''), 'image') AS slug
    FROM (SELECT doc_id, string_split(text, chr(10))[1] AS l FROM documents)"""
)
def slug(t):
    line, kind = F.substring_index("text", "\n", 1), F.col("doc_id") % 5
    name = F.when(kind == 0, F.concat(F.lit("a/b.c/"), line, F.lit(".pptx"))).when(kind == 1, F.concat(F.lit("  "), line, F.lit("! "))).when(kind == 2, F.concat(F.lit("图_"), line, F.lit("-x.tar.gz"))).when(kind == 3, "***").otherwise(line)
    return t("documents").select("doc_id", X.slug(name).alias("slug"))


_SAFE = "left(regexp_replace(regexp_replace(regexp_replace({}, '[ \\t\\r\\n\\f\\x0B]+', '_', 'g'), '[^一-龥a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g'), 80)"


@query(
    f"""SELECT page_id, coalesce(nullif({_SAFE.format("title")}, ''), nullif({_SAFE.format("CASE WHEN path <> '' THEN host || '_' || path ELSE host END")}, ''), 'untitled') AS base_name
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(html, '<title>([^<]*)</title>', 1) WHEN 1 THEN '' ELSE '...' END AS title, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host,
    regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/+|/+$', '', 'g') AS path FROM pages)"""
)
def url_base_names(t):
    title = F.when(F.col("page_id") % 3 == 0, F.regexp_extract("html", "<title>([^<]*)</title>", 1)).when(F.col("page_id") % 3 == 2, "...")
    return t("pages").select("page_id", X.url_base_name(title, F.col("url")).alias("base_name"))


_SITE_NAMES = ["", " - 某市政府网", " | Spark", "_数据门户-x", " -- 委员会 | y", "网站"]


@query(f"SELECT page_id, {_strip("regexp_replace(title, '[-_|].*?(政府|门户|网站|委员会).*$', '')")} AS title FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || [{', '.join(f"'{x}'" for x in _SITE_NAMES)}][CAST(page_id % 6 AS INT) + 1] AS title FROM pages)")
def clean_titles(t):
    ending = F.element_at(F.array(*[F.lit(x) for x in _SITE_NAMES]), (F.col("page_id") % 6 + 1).cast("int"))
    return t("pages").select("page_id", X.clean_title(F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), ending)).alias("title"))


_CANON = _strip(r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '(?m)^(Crawled|Imported):.*$', '\1:', 'g')")


@query(f"SELECT doc_id, md5({_CANON}) AS content_key FROM documents")
def canonical_content(t):
    return t("documents").select("doc_id", F.md5(X.canonical_content(F.col("text"))).alias("content_key"))


@query(f"SELECT conv_id, turn, trim(regexp_replace(translate(text || translate(text, 'aeT.', 'ａｅＴ．') || '　（１）', 'ａｅＴ．　（１）', 'aeT. (1)'), '{_B}+', ' ', 'g')) AS folded FROM conversations")
def half_width_fold(t):
    return t("conversations").select("conv_id", "turn", X.half_width(F.concat("text", F.translate("text", "aeT.", "ａｅＴ．"), F.lit("　（１）"))).alias("folded"))


@query(r"SELECT doc_id, regexp_replace(lower(regexp_replace(text, '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g') AS title FROM documents")
def normalized_titles(t):
    return t("documents").select("doc_id", X.normalized_title(F.col("text")).alias("title"))


@query("SELECT page_id, CAST(nullif(regexp_extract(k, '^ *([0-9]{1,3})', 1), '') AS INT) AS number, regexp_replace(k, '^[0-9]+ *[.|-] *', '') AS rest FROM (SELECT page_id, page_id || '. ' || url AS k FROM pages)")
def leading_numbers(t):
    k = F.concat(F.col("page_id").cast("string"), F.lit(". "), F.col("url"))
    return t("pages").select("page_id", X.leading_number(k).alias("number"), X.without_number(k).alias("rest"))


_LINE = f"regexp_replace(l, '{_B}+$', '')"
for _p in X.SPOKEN:
    _LINE = f"regexp_replace({_LINE}, '{_p}', '\\1', 'g')"
_MARKS = ["# {} #", "**{}** and *{}*", "  ## {}", "- [{}](http://x.y/z) ~~{}~~", "__{}__ _{}_ `{}`", "   ", "{}", ""]
_MARKED = " || chr(10) || ".join("'" + m.replace("{}", "' || l || '") + "'" for m in _MARKS)


@query(f"SELECT doc_id, md5({_strip(f"regexp_replace(array_to_string(list_transform(list_filter(string_split(md, chr(10)), lambda l: NOT starts_with(ltrim(l), '#')), lambda l: {_LINE}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")}) AS spoken FROM (SELECT doc_id, {_MARKED} || chr(10) || text AS md FROM (SELECT doc_id, text, string_split(text, chr(10))[1] AS l FROM documents))")
def spoken_text(t):
    """Whole texts under a head of all marks around their first line."""
    line = F.substring_index("text", "\n", 1)
    marked = [F.concat(*[x for part in m.split("{}") for x in (F.lit(part), line)][:-1]) for m in _MARKS]
    return t("documents").select("doc_id", F.md5(X.spoken(F.concat_ws("\n", *marked, "text"))).alias("spoken"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN w <= 0 OR h <= 0 THEN 'unknown' WHEN w > h THEN 'landscape' WHEN h > w THEN 'portrait' ELSE 'square' END AS orientation, CASE WHEN w / h > 2.0 THEN 'Ultra-wide' WHEN w / h > 1.5 THEN 'Wide landscape' WHEN w / h > 1.2 THEN 'Standard landscape' WHEN w / h > 0.8 THEN 'Near square' ELSE 'Portrait' END AS ratio_class FROM (SELECT l_orderkey, l_linenumber, l_quantity AS w, CAST(l_orderkey % 50 + 1 AS DOUBLE) AS h FROM lineitem)")
def aspect_class(t):
    w, h = F.col("l_quantity"), (F.col("l_orderkey") % 50 + 1).cast("double")
    return t("lineitem").select("l_orderkey", "l_linenumber", X.orientation(w, h).alias("orientation"), X.ratio_class(w / h).alias("ratio_class"))


def _any(text: str, marks) -> str:
    return "(" + " OR ".join(f"contains({text}, '{m}')" for m in marks) + ")"


_LICENSE_LINES = "(SELECT doc_id, l, regexp_replace(regexp_replace(l, '^(This work is )?([Ll]icensed|[Rr]eleased) under (the )?', ''), '[.]$', '') AS name FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) WHERE contains(lower(l), 'licen') OR contains(lower(l), 'rights reserved'))"


def _license_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l")).where(F.lower("l").contains("licen") | F.lower("l").contains("rights reserved"))
    return lines.withColumn("name", F.regexp_replace(F.regexp_replace("l", "^(This work is )?([Ll]icensed|[Rr]eleased) under (the )?", ""), "[.]$", ""))


@query(
    rf"""SELECT doc_id, name, CASE WHEN regexp_matches(lower(name), '{(c := "^ *cc[ -]+(by(?:[ -]+(?:sa|nc|nd))*) *([0-9.]*) *$")}') THEN trim('CC ' || upper(replace(regexp_extract(lower(name), '{c}', 1), ' ', '-')) || ' ' || regexp_extract(lower(name), '{c}', 2)) ELSE trim(name) END AS shown,
    CASE WHEN {_any("lower(trim(name))", X.REJECTED_MARKS)} THEN NULL WHEN {_any("lower(trim(name))", X.FREE_MARKS)} THEN 'no-attribution' WHEN {_any("lower(trim(name))", X.CREDIT_MARKS)} THEN 'attribution-required' END AS tier FROM {_LICENSE_LINES}"""
)
def license_tier(t):
    return _license_lines(t).select("doc_id", "name", X.license_name(F.col("name")).alias("shown"), X.license_tier(F.col("name"), F.lit(""), F.lit("")).alias("tier"))


_W = f"list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(text, '#[0-9a-fA-F]{{3,8}}', '', 'g'), '\\([^)]*\\)', '', 'g'), '{_B}+'), lambda w: regexp_replace(w, '^[.,;:!?\"()\\[\\]{{}}]+|[.,;:!?\"()\\[\\]{{}}]+$', '', 'g')), lambda w: length(w) > 2)"
_IN = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
_SEARCH = f"""(SELECT item_id, text, CASE WHEN len(soft) > 0 THEN soft ELSE hard END AS words FROM (SELECT *, list_filter(hard, lambda w: NOT list_contains({_IN(X.SOFT_NOISE_WORDS)}, lower(w))) AS soft
    FROM (SELECT item_id, text, list_filter({_W}, lambda w: NOT list_contains({_IN(X.NOISE_WORDS)}, lower(w))) AS hard FROM benchmark)))"""


@query(f"SELECT item_id, CASE WHEN len(words) = 0 THEN trim(text) ELSE array_to_string(words[1:4], ' ') END AS simple FROM {_SEARCH}")
def simplified_query(t):
    return t("benchmark").select("item_id", X.simpler_query(F.col("text")).alias("simple"))


@query(
    f"""SELECT item_id, rung, text FROM (SELECT item_id, unnest(range(1, len(l) + 1)) AS rung, unnest(l) AS text FROM (SELECT item_id,
    list_filter([trim(text)] || [array_to_string(words[1:n], ' ') FOR n IN [4, 3, 2, 1]], lambda q: q <> '') AS raw, list_filter(list_transform(range(1, len(raw) + 1), lambda i: CASE WHEN list_position(raw, raw[i]) = i THEN raw[i] END), lambda q: q IS NOT NULL) AS l FROM {_SEARCH}))"""
)
def query_ladder(t):
    return t("benchmark").select("item_id", F.posexplode(X.query_ladder(F.col("text"))).alias("rung", "text")).select("item_id", (F.col("rung") + 1).cast("long").alias("rung"), "text")


@query(
    """SELECT p_partkey, concat_ws(' — ', CASE p_partkey % 4 WHEN 0 THEN 'http://x/' || p_partkey WHEN 1 THEN 'image' ELSE 'part' || p_partkey || '.png' END, concat_ws(' ', '"' || p_name || '"', CASE WHEN p_partkey % 3 > 0 THEN 'by ' || p_brand END,
        'via ' || CASE p_partkey % 6 WHEN 0 THEN 'Openverse' WHEN 1 THEN 'Wikimedia Commons' WHEN 2 THEN 'Pexels' WHEN 3 THEN 'Pixabay' WHEN 4 THEN 'own' ELSE 'unknown' END),
        'license: ' || CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN p_type || ' (u/' || p_size || ')' WHEN 2 THEN 'u/' || p_size END) AS credit FROM part"""
)
def attribution_text(t):
    k = F.col("p_partkey")
    pick = lambda n, *values: F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), (k % n + 1).cast("int"))
    file, url = F.when(k % 4 > 1, F.concat(F.lit("part"), k, F.lit(".png"))), F.when(k % 4 == 0, F.concat(F.lit("http://x/"), k))
    terms, terms_url = pick(5, F.col("p_type"), F.col("p_type"), "", "", None), pick(5, "", F.concat(F.lit("u/"), "p_size"), F.concat(F.lit("u/"), "p_size"), None, "")
    credit = X.attribution(file, url, F.col("p_name"), F.when(k % 3 > 0, F.col("p_brand")), pick(6, "openverse", "wikimedia", "pexels", "pixabay", "own", ""), terms, terms_url)
    return t("part").select("p_partkey", credit.alias("credit"))


_PLACEHOLDER = X.PLACEHOLDER


_FILLED = "(SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN '<p>{{TITLE}} [[body]]</p>' WHEN 1 THEN '<TITLE>' WHEN 2 THEN '#{n}' ELSE '{{ }' END AS html FROM pages)"


@query(f"SELECT page_id, len(regexp_extract_all(html, '{_PLACEHOLDER}')) AS n FROM {_FILLED} WHERE regexp_matches(html, '{_PLACEHOLDER}')")
def placeholder_residue(t):
    """Placeholders left in pages made from a template: the table's pages, each with an end of a template that was filled or not."""
    end = F.when(F.col("page_id") % 4 == 0, "<p>{{TITLE}} [[body]]</p>").when(F.col("page_id") % 4 == 1, "<TITLE>").when(F.col("page_id") % 4 == 2, "#{n}").otherwise("{{ }")
    return t("pages").select("page_id", F.size(X.placeholders(F.concat("html", end))).cast("long").alias("n")).where("n > 0")


@query(
    "SELECT l_shipmode_region, count(*) AS n FROM (SELECT CASE WHEN l_quantity BETWEEN 0 AND 10 AND l_discount BETWEEN 0 AND 0.05 THEN 'top-left' WHEN l_quantity BETWEEN 10 AND 50 AND l_discount BETWEEN 0.05 AND 0.1 THEN 'bottom-right' ELSE 'none' END AS l_shipmode_region FROM lineitem) GROUP BY 1"
)
def region_containment(t):
    inside = lambda lo, hi, top, bottom: F.col("l_quantity").between(lo, hi) & F.col("l_discount").between(top, bottom)
    region = F.when(inside(0, 10, 0, 0.05), "top-left").when(inside(10, 50, 0.05, 0.1), "bottom-right").otherwise("none")
    return t("lineitem").groupBy(region.alias("l_shipmode_region")).agg(F.count("*").alias("n"))


_SOME_CHINESE = "(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN left(text, 12) || '年' || doc_id % 9 WHEN 1 THEN '第' || doc_id % 30 || '页' ELSE left(text, 12) END AS text FROM documents)"


@query(f"SELECT text, min(doc_id) AS first_seen FROM {_SOME_CHINESE} WHERE regexp_matches(text, '[一-鿿]') GROUP BY text")
def unique_texts_in_order(t):
    """Openings of documents, some with Chinese letters, once each."""
    kind = F.col("doc_id") % 4
    text = F.when(kind == 0, F.concat(F.left("text", F.lit(12)), F.lit("年"), F.col("doc_id") % 9)).when(kind == 1, F.concat(F.lit("第"), F.col("doc_id") % 30, F.lit("页"))).otherwise(F.left("text", F.lit(12)))
    return J.unique_texts(t("documents").select("doc_id", text.alias("text")), "text", F.col("doc_id"), f"[{X.CJK}]")


_PROJECT = "p_name || CASE p_partkey % 6 WHEN 0 THEN '_PPT169_2024' || lpad(CAST(1 + p_partkey % 14 AS VARCHAR), 2, '0') || '05' WHEN 1 THEN '_xhs_20240229' WHEN 2 THEN '_story' WHEN 3 THEN '_other_20240101' WHEN 4 THEN '_wechat-moment_20241231' ELSE '-20240101' END"


@query(
    f"""SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 3 THEN '_other' WHEN 5 THEN '-20240101' ELSE '' END AS name, [{', '.join(f"'{x}'" for x in ('ppt169', 'xiaohongshu', 'story'))}, NULL, 'moments', NULL][CAST(p_partkey % 6 AS INT) + 1] AS format,
    CAST(CASE p_partkey % 6 WHEN 0 THEN CASE WHEN p_partkey % 14 < 12 THEN TRY_CAST('2024-' || lpad(CAST(1 + p_partkey % 14 AS VARCHAR), 2, '0') || '-05' AS DATE) END WHEN 1 THEN DATE '2024-02-29' WHEN 3 THEN DATE '2024-01-01' WHEN 4 THEN DATE '2024-12-31' END AS VARCHAR) AS date FROM part"""
)
def project_names(t):
    """Parts as projects whose names say their format and date in six ways."""
    kind, k = F.col("p_partkey") % 6, F.col("p_partkey")
    ending = F.when(kind == 0, F.concat(F.lit("_PPT169_2024"), F.lpad((1 + k % 14).cast("string"), 2, "0"), F.lit("05"))).when(kind == 1, "_xhs_20240229").when(kind == 2, "_story").when(kind == 3, "_other_20240101").when(kind == 4, "_wechat-moment_20241231").otherwise("-20240101")
    found = X.project_name(F.concat("p_name", ending))
    return t("part").select("p_partkey", found["name"].alias("name"), found["format"].alias("format"), found["date"].cast("string").alias("date"))
