"""Text features as Column -> Column functions; no UDF anywhere.

Character classes are explicit (``[a-z0-9]``), so results don't depend on a dialect's idea of ``\\w``.
A null text is treated as empty unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\r\n\f\x0B]"
#: The CJK block that counts as Chinese text, as a class body.
CJK = r"一-鿿"

#: Function words that the content tokeniser leaves out of its two-character grams.
STOP_WORDS = (
    "的 了 在 是 有 和 就 都 一 不 也 这 那 与 及 或 对 从 到 把 被 让 向 从 为 以 而 但 "
    "等 其 各 另 之 所 可 该 已 将 会 将 要 能 如 着 了 过 又 并 它 她 他 们 上 下 中 "
    "个 去 没 还 很 更 最 只 只 被 让 可以 需要 进行 通过 使用 采用 用于 提供 实现 包括 "
    "具有 同时 目前 已经 相关 一个 一些 所有 任何 其他 以及 其中 主要 根据 按照 除了 "
    "不仅 还是 然而 虽然 但是 因为 所以 因此 如果 例如 比如"
).split()


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column) -> Column:
    """Without blanks at both ends."""
    return F.btrim(c, F.lit(" \t\r\n\f\x0b"))


def collapse(c: Column) -> Column:
    """Each run of blanks as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{BLANK}+", " "))


def no_strings() -> Column:
    return F.array().cast("array<string>")


def text_runs(markup: Column, tag: str) -> Column:
    """The bodies of a tag's elements that have any text, joined by spaces."""
    bodies = F.regexp_extract_all(markup, F.lit(f"<{tag}[^>]*>([^<]*)</{tag}>"), F.lit(1))
    return F.array_join(F.filter(bodies, lambda x: strip(x) != ""), " ")


def is_keyword(run: Column) -> Column:
    """A trimmed run of 2 to 30 characters that isn't only digits and punctuation."""
    return F.length(run).between(2, 30) & ~run.rlike(r"^[0-9 .,;:!?()\[\]{}_+=*/\\|%-]+$")


def keywords(runs: Column) -> Column:
    # a run is stripped once, however often a text has it
    return F.array_distinct(F.filter(F.transform(F.array_distinct(runs), strip), is_keyword))


def char_grams(s: Column, n: int) -> Column:
    """The windows of n characters of a string, in order."""
    return F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))).otherwise(no_strings())


def search_tokens(text: Column) -> Column:
    """The set of a text's search tokens, lower-cased.

    Whole runs of Chinese characters, their windows of two to four characters where a run has four or
    more, words of 2 to 30 Latin letters that stand alone, and runs of digits of any script.
    """
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit(f"[{CJK}]+"), F.lit(0))
    windows = F.flatten(F.transform(runs, lambda r: F.when(F.length(r) >= 4, F.concat(char_grams(r, 2), char_grams(r, 3), char_grams(r, 4))).otherwise(no_strings())))
    words = F.regexp_extract_all(text, F.lit(r"(?<![\p{L}\p{N}_])[a-zA-Z]{2,30}(?![\p{L}\p{N}_])"), F.lit(0))
    digits = F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0))
    return F.array_distinct(F.transform(F.concat(runs, windows, words, digits), F.lower))


def content_tokens(text: Column) -> Column:
    """The bag of a text's content tokens: runs of letters and digits, and Chinese grams.

    Chinese characters are joined across gaps first; two-character grams that are function words go.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    joined = F.regexp_replace(low, f"[^{CJK}]+", "")
    two = F.filter(char_grams(joined, 2), lambda g: ~g.isin(STOP_WORDS))
    return F.when(joined == "", words).otherwise(F.concat(words, two, char_grams(joined, 3)))


def query_terms(query: Column) -> Column:
    """Lower-cased terms between blanks and commas."""
    return F.filter(F.split(F.lower(query), "[ \\t\\r\\n,，、]+"), lambda t: t != "")


def occurrences(text: Column, term: Column) -> Column:
    """How often a non-empty term occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("int")


def embedding_text(title: Column, words: Column, text: Column) -> Column:
    """Title, keywords and text in one string; over 1000 characters the text alone, cut to 800."""
    whole = F.concat_ws(" ", title, F.array_join(words, " "), text)
    return F.when(F.length(whole) > 1000, F.left(text, F.lit(800))).otherwise(whole)


def preview(text: Column, terms: list[str], before: int = 30, after: int = 120) -> Column:
    """A window around the earliest term, with dots where text is left out; the start if no term occurs."""
    low = F.lower(text)
    found = F.array_min(F.filter(F.array(*[F.locate(t, low) for t in terms]), lambda p: p > 0))
    start = F.greatest(F.coalesce(found, F.lit(1)) - before, F.lit(1))
    end = F.least(F.coalesce(found, F.lit(1)) + after, F.length(text) + 1)
    return F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))


def normalized(text: Column, longest: int = 512) -> Column:
    return F.left(collapse(text), F.lit(longest))


def _word_runs(name: Column) -> Column:
    """Runs of anything but letters, digits and Chinese as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, f"[^\\p{{L}}\\p{{N}}{CJK}]+", "_"), "^_+|_+$", "")


def slug(name: Column, longest: int = 30) -> Column:
    """A file's name as a short label: without folders and ending, other characters than letters and digits as single underscores; ``image`` if nothing is left."""
    file = F.regexp_replace(F.element_at(F.split(F.regexp_replace(F.coalesce(name, F.lit("")), "/+$", ""), "/"), -1), r"(?<=.)\.[^.]+$", "")
    return F.coalesce(F.nullif(F.left(_word_runs(file), F.lit(longest)), F.lit("")), F.lit("image"))


def clean_title(title: Column) -> Column:
    """Without what follows a dash, underscore or bar, if it names a government, portal, website or committee (the words are fixed values)."""
    return strip(F.regexp_replace(F.coalesce(title, F.lit("")), "[-_|].*?(政府|门户|网站|委员会).*$", ""))


def file_safe(name: Column, longest: int = 80) -> Column:
    """Blanks as underscores, other characters than letters of English, digits and Chinese left out, runs of underscores as one."""
    return F.left(F.regexp_replace(F.regexp_replace(F.regexp_replace(name, f"{BLANK}+", "_"), "[^一-龥a-zA-Z0-9_]", ""), "_+", "_"), F.lit(longest))


def url_base_name(title: Column, url: Column) -> Column:
    """A file name from the title, or else the URL's host and path, or its host, or ``untitled``."""
    host = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    path = F.regexp_replace(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1), "^/+|/+$", "")
    fallback = F.when(path != "", F.concat_ws("_", host, path)).otherwise(F.coalesce(F.nullif(host, F.lit("")), F.lit("untitled")))
    return F.coalesce(F.nullif(file_safe(F.coalesce(title, F.lit(""))), F.lit("")), F.nullif(file_safe(fallback), F.lit("")), F.lit("untitled"))


def canonical_content(text: Column) -> Column:
    """One form for texts that differ in line ends, import stamps or outer blanks only."""
    return strip(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "(?m)^(Crawled|Imported):.*$", "$1:"))


def half_width(text: Column) -> Column:
    """Full-width forms as ASCII, the ideographic space too; blanks collapsed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    narrow = "".join(chr(c) for c in range(0x21, 0x7F)) + " "
    return collapse(F.translate(text, wide, narrow))


def normalized_title(title: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(title, f"[^a-zA-Z0-9{CJK}]+", "_")), "^_+|_+$", "")


def leading_number(title: Column) -> Column:
    """The number of up to three digits that a title begins with, bare or after a word for slide or page; null without one."""
    plain = F.regexp_extract(title, "^ *([0-9]{1,3})", 1)
    named = F.regexp_extract(F.lower(title), "^ *(?:slide|page|p) *[-_:]? *([0-9]{1,3})", 1)
    chinese = F.regexp_extract(title, "^ *第 *([0-9]{1,3}) *[页张]", 1)
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (plain, named, chinese)]).cast("int")


def without_number(title: Column) -> Column:
    return F.regexp_replace(title, r"^[0-9]+ *[.\-|] *", "")


#: Marks around a text, the longer ones first, and links: what is left of them when they are read aloud.
SPOKEN = (r"\*\*(.+?)\*\*", "__(.+?)__", r"\*(.+?)\*", "_(.+?)_", "~~(.+?)~~", "`(.+?)`", r"\[(.+?)\]\(.+?\)")


def spoken(markdown: Column) -> Column:
    """Markdown as it is read aloud: without lines of headings and the marks of emphasis, deletion, code and links; runs of blank lines are one."""

    def line(x: Column) -> Column:
        x = F.regexp_replace(x, f"{BLANK}+$", "")
        for pattern in SPOKEN:
            x = F.regexp_replace(x, pattern, "$1")
        return x

    lines = F.filter(F.split(markdown, "\r\n|\n|\r"), lambda x: ~F.ltrim(x).startswith("#"))
    return strip(F.regexp_replace(F.array_join(F.transform(lines, line), "\n"), "\n{3,}", "\n\n"))


def orientation(width: Column, height: Column) -> Column:
    return F.when((width <= 0) | (height <= 0), "unknown").when(width > height, "landscape").when(height > width, "portrait").otherwise("square")


def ratio_class(ratio: Column) -> Column:
    """Five classes of width to height; their names are fixed values."""
    return F.when(ratio > 2.0, "Ultra-wide").when(ratio > 1.5, "Wide landscape").when(ratio > 1.2, "Standard landscape").when(ratio > 0.8, "Near square").otherwise("Portrait")


#: Display names of licences by their lower-case aliases.
LICENSE_NAMES = {"cc0": "CC0", "cc 0": "CC0", "public domain": "Public Domain", "publicdomain": "Public Domain", "pdm": "Public Domain", "pexels license": "Pexels License", "pixabay content license": "Pixabay Content License", "pixabay license": "Pixabay Content License"}
#: Marks of licences that reject an asset, need no credit, or need one.
REJECTED_MARKS = ("by-nc", "by nc", "noncommercial", "non-commercial", "by-nd", "by nd", "no derivatives", "noderivatives", "all rights reserved")
FREE_MARKS = ("cc0", "public domain", "publicdomain", "creativecommons.org/publicdomain/", "pexels license", "pixabay content license", "pixabay license")
CREDIT_MARKS = ("cc by", "cc-by", "by-sa", "by sa", "creativecommons.org/licenses/by/", "creativecommons.org/licenses/by-sa/")


def any_contained(text: Column, marks: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | text.contains(m)
    return out


def license_name(name: Column) -> Column:
    """The display form of a licence's name; unknown names only trimmed."""
    key = F.lower(strip(F.coalesce(name, F.lit(""))))
    out = strip(F.coalesce(name, F.lit("")))
    parts = r"^ *cc[ -]+(by(?:[ -]+(?:sa|nc|nd))*) *([0-9.]*) *$"
    named = F.trim(F.concat(F.lit("CC "), F.upper(F.replace(F.regexp_extract(key, parts, 1), F.lit(" "), F.lit("-"))), F.lit(" "), F.regexp_extract(key, parts, 2)))
    out = F.when(key.rlike(parts), named).otherwise(out)
    for alias, shown in LICENSE_NAMES.items():
        out = F.when(key == alias, shown).otherwise(out)
    return out


def license_tier(name: Column, url: Column, provider: Column) -> Column:
    """no-attribution, attribution-required, or null for an asset to reject."""
    text = F.concat_ws(" ", *[F.nullif(F.lower(F.trim(x)), F.lit("")) for x in (name, url)])
    key = F.lower(F.trim(F.coalesce(provider, F.lit(""))))
    own = key.isin("pexels", "pixabay") & (F.instr(text, key) > 0) & ~any_contained(text, CREDIT_MARKS)
    return F.when(any_contained(text, REJECTED_MARKS), F.lit(None)).when(any_contained(text, FREE_MARKS) | own, "no-attribution").when(any_contained(text, CREDIT_MARKS), "attribution-required")


#: Words that a search never needs, and words that it needs only if nothing else is left.
NOISE_WORDS = (
    "claude openai gpt gemini copilot chatgpt midjourney stable diffusion dall-e cursor anthropic microsoft google apple meta nvidia tesla "
    "using with from that this have been will into more also very some than them other"
).split()
SOFT_NOISE_WORDS = (
    "ai code software system digital platform solution application interface framework algorithm api sdk assistant tool service technology tech program "
    "professional editorial commercial premium stock photo photograph photography image picture visual background hero cover banner wallpaper "
    "high quality resolution sharp clean cinematic dramatic lighting light modern natural visible"
).split()
OUTER_MARKS = r"""[.,;:!?"'()\[\]{}，。；：！？、]"""


def search_words(query: Column) -> Column:
    """The words of a query that say what is searched for, in order; empty if none is left."""
    clean = F.regexp_replace(F.regexp_replace(query, "#[0-9a-fA-F]{3,8}", ""), r"\([^)]*\)", "")
    words = F.filter(F.transform(F.split(clean, f"{BLANK}+"), lambda w: F.regexp_replace(w, f"^{OUTER_MARKS}+|{OUTER_MARKS}+$", "")), lambda w: F.length(w) > 2)
    hard = F.filter(words, lambda w: ~F.lower(w).isin(NOISE_WORDS))
    soft = F.filter(hard, lambda w: ~F.lower(w).isin(SOFT_NOISE_WORDS))
    return F.when(F.size(soft) > 0, soft).otherwise(hard)


def simpler_query(query: Column, most: int = 4) -> Column:
    words = search_words(query)
    return F.when(F.size(words) == 0, strip(query)).otherwise(F.array_join(F.slice(words, 1, most), " "))


def query_ladder(query: Column) -> Column:
    """The query and ever shorter forms of it, without repeats."""
    return F.array_distinct(F.filter(F.array(strip(query), *[simpler_query(query, n) for n in (4, 3, 2, 1)]), lambda q: q != ""))


#: Display names of providers.
PROVIDER_NAMES = {"openverse": "Openverse", "wikimedia": "Wikimedia Commons", "pexels": "Pexels", "pixabay": "Pixabay"}


def attribution(file: Column, url: Column, title: Column, author: Column, provider: Column, license_: Column, license_url: Column) -> Column:
    """A credit: ``file — "title" by author via Provider — license: name (url)``; what is missing is left out. Without a file its address, or ``image``."""
    some = lambda c: F.nullif(c, F.lit(""))
    shown = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in PROVIDER_NAMES.items() for x in pair]), provider), some(provider), F.lit("unknown"))
    middle = F.concat_ws(" ", F.concat(F.lit('"'), some(title), F.lit('"')), F.concat(F.lit("by "), some(author)), F.concat(F.lit("via "), shown))
    terms = F.coalesce(F.concat(some(license_), F.lit(" ("), some(license_url), F.lit(")")), some(license_), some(license_url))
    return F.concat_ws(" — ", F.coalesce(some(file), some(url), F.lit("image")), middle, F.concat(F.lit("license: "), terms))


#: What is left of a template's placeholders.
PLACEHOLDER = r"\{\{[^}]*\}\}|\[\[[^\]]*\]\]|\{TITLE\}|\{PAGE_TITLE\}|\{CHAPTER\}|\{SUBTITLE\}|<TITLE>|<SUBTITLE>|#\{[^}]*\}"


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


#: Canvas formats, and other names of them.
CANVAS_FORMATS = ("ppt169", "ppt43", "wechat", "xiaohongshu", "moments", "story", "banner", "a4")
FORMAT_ALIASES = {"xhs": "xiaohongshu", "wechat_moment": "moments", "wechat-moment": "moments", "朋友圈": "moments", "小红书": "xiaohongshu"}


def project_name(name: Column) -> dict[str, Column]:
    """name, format and date of ``name_format_YYYYMMDD``, the format by its name or another name of it; else what stands before a known format and a date at the end. Null without a known format, or a date."""
    low, shape = F.lower(name), r"^(.+)_([a-z0-9_-]+)_([0-9]{8})$"
    raw = F.regexp_extract(low, shape, 2)
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in FORMAT_ALIASES.items() for x in pair]), raw), raw)
    fits = low.rlike(shape) & known.isin(*CANVAS_FORMATS)
    longest = "|".join(sorted(CANVAS_FORMATS, key=len, reverse=True))
    at_end = F.nullif(F.regexp_extract(low, f"_({longest})(?:_[0-9]{{8}})?$", 1), F.lit(""))
    undated = F.regexp_replace(name, "_[0-9]{8}$", "")
    rest = F.when(at_end.isNull(), undated).otherwise(F.regexp_replace(undated, f"(?i)_({longest})$", ""))
    return {
        "name": F.when(fits, F.left(name, F.length(F.regexp_extract(low, shape, 1)))).otherwise(rest),
        "format": F.when(fits, known).otherwise(at_end),
        "date": F.try_to_date(F.nullif(F.regexp_extract(name, "_([0-9]{8})$", 1), F.lit("")), "yyyyMMdd"),
    }


def has_chinese(text: Column) -> Column:
    return F.coalesce(text.rlike(f"[{CJK}]"), F.lit(False))


def search_tags(format_: Column, stem: Column, context: Column) -> Column:
    """A sorted set of tags: the format, name parts, Chinese runs of 2 to 8 and words of 3 to 20 letters of the context."""
    parts = F.filter(F.split(F.lower(stem), "[^a-z0-9]+"), lambda x: F.length(x) >= 2)
    chinese = F.regexp_extract_all(context, F.lit(f"[{CJK}]{{2,8}}"), F.lit(0))
    words = F.filter(F.regexp_extract_all(F.lower(context), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w).between(3, 20))
    return F.array_sort(F.array_distinct(F.concat(F.array(F.lower(format_)), parts, chinese, words)))


def description_hint(title: Column, context: Column, name: Column) -> Column:
    hint = F.concat_ws(" | ", F.nullif(F.left(title, F.lit(80)), F.lit("")), F.nullif(F.left(context, F.lit(120)), F.lit("")))
    return F.coalesce(F.nullif(hint, F.lit("")), name)


def first_line_title(text: Column) -> Column:
    """The first line, cut to 80 characters, if it has over 5; else null."""
    line = strip(F.element_at(F.split(text, "\n"), 1))
    return F.when(F.length(line) > 5, F.left(line, F.lit(80)))
