"""Document structure from text, markup and spans: metadata, headings, lists, noise, chapters, islands."""

from __future__ import annotations

from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .crawl import resolved
from .scans import ends_before_next

#: Elements without content of their own.
CLUTTER = ("script", "style", "nav", "footer", "header", "aside", "noscript", "iframe")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")


def unescaped(text: Column) -> Column:
    """The five XML entities resolved."""
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(by))
    return text


def strip_html(markup: Column) -> Column:
    """Markup as plain text: tags out, the five XML entities resolved, blanks collapsed."""
    out = F.regexp_replace(markup, "<[^>]+>", " ")
    for entity, by in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(by))
    return X.collapse(out)


#: Where a page's metadata stand, the first that is there counts; and patterns of dates and sources in its text.
DATE_METAS = ("article:published_time", "og:published_time", "pubdate", "publishdate", "date")
DESCRIPTION_METAS, AUTHOR_METAS = ("description", "og:description", "twitter:description"), ("author", "article:author")
_DAY = r"\d{4}[-/年]\d{1,2}[-/月]\d{1,2}日?"
DATE_PATTERNS = (rf"发布[时日]间[：:]\s*({_DAY})", rf"日期[：:]\s*({_DAY})", rf"({_DAY})\s*(?:发布|来源)", r"时间[：:]\s*(\d{4}[-/]\d{1,2}[-/]\d{1,2})")
SOURCE_PATTERNS = (r"来源[：:]\s*([^\s<]+)", r"发布(?:单位|机构)[：:]\s*([^\s<]+)")


def meta_tags(html: Column) -> Column:
    """A map of a page's meta tags: the lower-cased name, or property, to its content; the last of a name counts."""
    attribute = lambda tag, name: F.regexp_extract(tag, rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", 0)
    value = lambda tag, name: F.regexp_replace(attribute(tag, name), r"(?s)^[^=]*=\s*.(.*).$", "$1")
    pairs = F.transform(F.regexp_extract_all(html, F.lit("(?is)<meta\\b[^>]*>"), F.lit(0)), lambda tag: F.struct(F.lower(F.coalesce(F.nullif(value(tag, "name"), F.lit("")), value(tag, "property"))).alias("k"), X.strip(unescaped(value(tag, "content"))).alias("v")))
    named = F.filter(pairs, lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.map_from_arrays(F.array(x["k"]), F.array(x["v"]))))


def page_metadata(html: Column, url: Column, metas: Column | None = None) -> dict[str, Column]:
    """title (without a site's name), date, description and author; the date from meta tags, else from the text, else from the address.

    Missing ones are empty, a missing title is ``Untitled``. ``metas``: :func:`meta_tags` of the page, if it is at hand as a column.
    """
    metas = meta_tags(html) if metas is None else metas
    first = lambda names: F.coalesce(*[F.try_element_at(metas, F.lit(n)) for n in names])
    found = lambda c, p, g=1: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    text = unescaped(F.regexp_replace(html, "<[^>]*>", ""))
    day = F.regexp_replace(F.translate(F.coalesce(*[found(text, p) for p in DATE_PATTERNS]), "年月", "--"), "日", "")
    month, in_url = r"(\d{4})(\d{2})[/_](?:t\d+_)?", r"(\d{4})[-/](\d{2})[-/](\d{2})"
    by_url = F.coalesce(F.when(url.rlike(month), F.concat_ws("-", F.regexp_extract(url, month, 1), F.regexp_extract(url, month, 2))), F.when(url.rlike(in_url), F.concat_ws("-", *[F.regexp_extract(url, in_url, g) for g in (1, 2, 3)])))
    title = X.clean_title(unescaped(F.regexp_extract(html, "(?is)<title[^>]*>([^<]*)</title>", 1)))
    empty = F.lit("")
    return {
        "title": F.coalesce(F.nullif(title, empty), F.try_element_at(metas, F.lit("og:title")), F.lit("Untitled")),
        "date": F.coalesce(first(DATE_METAS), day, by_url, empty),
        "description": F.coalesce(first(DESCRIPTION_METAS), empty),
        "author": F.coalesce(first(AUTHOR_METAS), *[found(text, p) for p in SOURCE_PATTERNS], empty),
    }


def links(pages: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, link): absolute addresses of all anchors; relative ones resolved against the page's address."""
    found = pages.select(key, url, F.explode(F.array_distinct(F.regexp_extract_all(F.col(html), F.lit('href="([^"#]+)"'), F.lit(1)))).alias("href"))
    return found.select(key, resolved(F.col(url), F.col("href")).alias("link"))


#: Classes and ids that contents of pages often have; of the first two a part is enough, whatever its case.
CONTENT_CLASS_PARTS = ["tys-main-zt-show", "tys-main"]
CONTENT_CLASSES = "TRS_Editor TRS_UEDITOR ucontent article-content news-content detail-content content-text pages_content zwgk_content content_detail text_content main-content main_content view-content info-content content".split()
CONTENT_IDS = ["Zoom", "content", "article"]
#: Least characters of a named container, of a plain one, and the score under which plain ones are tried; what a Chinese character and a paragraph add.
NAMED_LEAST, PLAIN_LEAST, WEAK_SCORE, CJK_WORTH, PARAGRAPH_WORTH = 100, 200, 200, 2, 50


class _Tree(HTMLParser):
    """Collects markdown lines and candidate containers of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip = 0
        self.lines: list[str] = []
        self.line = ""
        self.mark = ""
        self.href: list[str] = []
        # open containers: tag, whether it is named as content, lines, characters and Chinese characters before it, paragraphs right in it
        self.stack: list[list] = []
        self.boxes: list[tuple[str, bool, int, int, int, int, int]] = []
        self.chars = self.chinese = 0

    def flush(self):
        text = " ".join(self.line.split())
        if text:
            self.lines.append(self.mark + text)
        self.line, self.mark = "", ""

    def handle_starttag(self, tag, attrs):
        if tag in CLUTTER:
            self.skip += 1
        if self.skip:
            return
        if tag in ("p", "div", "section", "article", "main", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "br", "ul", "ol", "table"):
            self.flush()
        if tag[0] == "h" and tag[1:].isdigit():
            self.mark = "#" * int(tag[1:]) + " "
        elif tag == "li":
            self.mark = "- "
        elif tag == "a":
            self.href.append(dict(attrs).get("href") or "")
            self.line += "["
        if tag == "p" and self.stack:
            self.stack[-1][5] += 1
        if tag in ("div", "section", "article", "main", "body"):
            have = dict(attrs)
            classes = (have.get("class") or "").split()
            named = tag in ("article", "main") or have.get("id") in CONTENT_IDS or any(c in CONTENT_CLASSES or any(x in c.lower() for x in CONTENT_CLASS_PARTS) for c in classes)
            self.stack.append([tag, named, len(self.lines), self.chars, self.chinese, 0])

    def handle_endtag(self, tag):
        if tag in CLUTTER and self.skip:
            self.skip -= 1
            return
        if self.skip:
            return
        if tag == "a" and self.href:
            self.line += f"]({self.href.pop()})"
        elif tag not in VOID and tag not in ("b", "i", "em", "strong", "span", "code"):
            self.flush()
        if tag in ("div", "section", "article", "main", "body") and self.stack:
            name, named, low, chars, chinese, paragraphs = self.stack.pop()
            self.boxes.append((name, named, low, len(self.lines), self.chars - chars, self.chinese - chinese, paragraphs))

    def handle_data(self, data):
        if not self.skip:
            self.line += data
            text = data.strip()
            self.chars += len(text)
            self.chinese += sum("\u4e00" <= c <= "\u9fa5" for c in text)


def markdown_of(html: str | None) -> tuple[str, str]:
    """(main content, whole page) of a page as Markdown.

    The main content is the container of the highest score, its characters and twice its Chinese ones: of those that are named as content, from
    100 characters on; if the best of these is weak, of the plain ones of over 200 characters with paragraphs right in them, each of which adds 50. Else the whole page.
    """
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    tree.flush()
    whole, best, top = "\n\n".join(tree.lines), None, 0
    for _, named, low, high, chars, chinese, _ in tree.boxes:
        if named and chars >= NAMED_LEAST and chars + CJK_WORTH * chinese > top:
            best, top = (low, high), chars + CJK_WORTH * chinese
    if top < WEAK_SCORE:
        for tag, _, low, high, chars, chinese, paragraphs in tree.boxes:
            score = chars + CJK_WORTH * chinese + PARAGRAPH_WORTH * paragraphs
            if tag == "div" and chars > PLAIN_LEAST and paragraphs and score > top:
                best, top = (low, high), score
    return ("\n\n".join(tree.lines[slice(*best)]) if best else whole), whole


#: Pages that a worker unpacks from a batch at once.
PAGES = 128


def html_to_markdown(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, main, markdown): a parser is needed here, so pages go through it in Arrow batches, of which only a few pages are Python objects at a time."""
    kinds = dict(pages.dtypes)

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, PAGES):
                some = batch.slice(low, PAGES)
                found = [markdown_of(x) for x in some.column(1).to_pylist()]
                columns = [some.column(0), *(pa.array(list(x), pa.string()) for x in zip(*found, strict=True))]
                yield pa.RecordBatch.from_arrays(columns, [key, "main", "markdown"])

    return pages.select(key, html).mapInArrow(run, f"{key} {kinds[key]}, main string, markdown string")


def font_levels(spans: DataFrame, doc: str, size: str, text: str) -> DataFrame:
    """(doc, size, level): 0 for the body's size (the one of most characters), 1 to 3 for larger ones by rank."""
    chars = spans.groupBy(doc, size).agg(F.sum(F.length(text)).alias("chars"))
    body = chars.groupBy(doc).agg(F.min_by(size, F.struct(-F.col("chars"), F.col(size))).alias("body"))
    rows = chars.join(body, doc).where(f"{size} = body or {size} > body + 1")
    rank = F.dense_rank().over(Window.partitionBy(doc).orderBy(F.desc(size)))
    return rows.select(doc, size, F.when(F.col(size) == F.col("body"), 0).otherwise(rank).alias("level")).where("level <= 3")


#: What a heading may be: its size under a level's by so much, its length, the body's size where none is known, and how much larger a plain lower heading must be.
NEARLY, LONGEST_HEADING, BODY_SIZE, CLEARLY = 0.5, 80, 12, 2


def heading_level(size: Column, sizes: dict[str, Column], text: Column, bold: Column) -> Column:
    """The level of a line by its size: 1 to 3, 0 for none. ``sizes``: h1, h2, h3 and body, null where a document has none.

    Long lines are none; nor are sentences, but for numbered headings that end in a full stop; nor are lower headings in plain type that are hardly larger than the body.
    """
    level = F.lit(0)
    for n in (3, 2, 1):
        level = F.when(F.coalesce(size >= sizes[f"h{n}"] - NEARLY, F.lit(False)), n).otherwise(level)
    line = X.strip(text)
    sentence = line.rlike("[.。!！?？]$") & ~line.rlike("^[0-9第]+[.、章节]")
    weak = ~bold & (level >= 2) & (size < F.coalesce(sizes["body"], F.lit(BODY_SIZE)) + CLEARLY)
    return F.when((level > 0) & ((F.length(line) > LONGEST_HEADING) | sentence | weak), 0).otherwise(level)


def list_item(line: Column) -> Column:
    """A list item in one form (``- x`` or ``1. x``); null for other lines. Round and angular bullets need no blank, dashes and asterisks do."""
    line = X.strip(line)
    bullet, number = f"^([•●○◦▪▸►]{X.BLANK}*|[-–—*]{X.BLANK}+)", f"^([0-9]+)[.、)]{X.BLANK}*"
    return F.when(line.rlike(bullet), F.regexp_replace(line, bullet, "- ")).when(line.rlike(number), F.regexp_replace(line, number, "$1. "))


MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def without_footer(text: Column) -> Column:
    """Without a month, year and page number at the end (``November 2025 8``, ``2025年11月 8``), and blanks there."""
    blank = X.BLANK
    out = F.regexp_replace(text, f"(?i){blank}*(?:{MONTHS}){blank}+[0-9]{{4}}{blank}+[0-9]{{1,3}}{blank}*$", "")
    out = F.regexp_replace(out, f"{blank}*[0-9]{{4}}年[0-9]{{1,2}}月{blank}+[0-9]{{1,3}}{blank}*$", "")
    return F.regexp_replace(out, f"{blank}+$", "")


def clean_blank_lines(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[ \\t]+(\n|$)", "$1"), "\n{3,}", "\n\n")


#: The share of a page's height that is its head, and its foot; of long documents' pages so many at both ends count.
BAND, EDGE_PAGES, ALL_PAGES = 0.15, 20, 40


def repeated_blocks(blocks: DataFrame, doc: str, page: str, text: str, share: float = 0.6, sample: int | None = EDGE_PAGES, above: int = ALL_PAGES, pages: DataFrame | None = None) -> DataFrame:
    """(doc, text, times, pages): running heads and feet: texts of blocks (y0, y1, height) that touch the top of a page, or else the bottom, on over ``share`` of the pages.

    Heads and feet are counted apart, by occurrences; of documents of over ``above`` pages the first and last ``sample`` count, or all if that is None; those of under 3 have none.
    ``pages`` has a row (doc, page) for those without a block too; else the pages are those of the blocks.
    """
    pages = (blocks if pages is None else pages).select(doc, page)
    on = [doc]
    if sample is None:
        picked = pages.groupBy(doc).agg(F.count_distinct(page).alias("pages")).where("pages >= 3")
    else:
        pages, on = pages.distinct(), [doc, page]
        ends = pages.groupBy(doc).agg(F.count("*").alias("_n")).where("_n >= 3")
        rank = lambda order: F.row_number().over(Window.partitionBy(doc).orderBy(order))
        picked = pages.join(ends, doc).withColumns({"_up": rank(F.asc(page)), "_down": rank(F.desc(page))}).where((F.col("_n") <= above) | (F.col("_up") <= sample) | (F.col("_down") <= sample))
        picked = picked.select(doc, page, F.when(F.col("_n") <= above, F.col("_n")).otherwise(2 * sample).alias("pages"))
    line, edge = X.strip(F.col(text)), BAND * F.col("height")
    band = F.when((F.col("y0") < edge) & (F.col("y1") > 0), "head").when((F.col("y1") > F.col("height") - edge) & (F.col("y0") < F.col("height")), "foot")
    rows = blocks.select(doc, page, line.alias(text), band.alias("_band")).where(f"_band is not null and {text} != ''").join(picked, on)
    counts = rows.groupBy(doc, text, "_band", "pages").agg(F.count("*").alias("times")).where(F.col("times") / F.col("pages") > share)
    return counts.groupBy(doc, text).agg(F.max("times").alias("times"), F.max("pages").alias("pages"))


def without_noise(blocks: DataFrame, noise: DataFrame, doc: str, text: str, by_line: bool = True) -> DataFrame:
    """Blocks whose text is no running head or foot of their document (doc, text), ``by_line`` without their lines that are; blocks of which nothing is left go."""
    found = noise.select(doc, F.col(text).alias("_noise")).distinct()
    left = blocks.withColumn("_noise", X.strip(F.col(text))).join(found, [doc, "_noise"], "left_anti").drop("_noise")
    # a document's noise is what its head and foot say: few texts
    lines = left.join(found.groupBy(doc).agg(F.collect_set("_noise").alias("_set")), doc, "left")
    if not by_line:
        return lines.where((F.trim(text) != "") | F.col("_set").isNull()).drop("_set")
    kept = F.filter(F.split(text, "\n"), lambda x: ~F.coalesce(F.array_contains(F.col("_set"), X.strip(x)), F.lit(False)))
    return lines.withColumn(text, F.array_join(kept, "\n")).where((F.trim(text) != "") | F.col("_set").isNull()).drop("_set")


#: A chapter's number and title on a page.
CHAPTER = r"第\s*([0-9]+)\s*章\s*([^\n]+)"


def chapters(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, chapter, title, start, end, pages): pages that name a chapter begin one, which ends before the next one's or with the document."""
    last = pages.groupBy(doc).agg(F.max(page).alias("_last"))
    found = pages.where(F.col(text).rlike(CHAPTER)).select(doc, F.regexp_extract(text, CHAPTER, 1).cast("int").alias("chapter"), X.strip(F.regexp_extract(text, CHAPTER, 2)).alias("title"), F.col(page).alias("start"))
    out = ends_before_next(found.join(last, doc), doc, "start", "_last").drop("_last")
    return out.withColumn("pages", F.col("end") - F.col("start") + 1)


def front_matter(pages: DataFrame, doc: str, page: str, text: str, starts: DataFrame, trivial: int = 50) -> DataFrame:
    """(doc, end): the pages, from 0, before a document's first chapter, if there are two or more and one of them has over ``trivial`` characters."""
    first = starts.groupBy(doc).agg(F.min("start").alias("_first")).where("_first > 1")
    before = pages.join(first, doc).where(F.col(page) < F.col("_first"))
    return before.groupBy(doc, "_first").agg(F.max(F.length(X.strip(F.col(text)))).alias("_most")).where(F.col("_most") > trivial).select(doc, (F.col("_first") - 1).alias("end"))


def _evenly(first: Column, last: Column, most: int) -> Column:
    """An array of (first, last): the fewest chunks of at most ``most`` pages, as even as can be, the longer ones first."""
    n = last - first + 1
    parts = F.ceil(n / most)
    base, more = F.floor(n / parts), n % parts
    at = lambda k: first + k * base + F.least(k, more)
    return F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda k: F.struct(at(k).cast("long").alias("first"), (at(k + 1) - 1).cast("long").alias("last")))


def even_chunks(ranges: DataFrame, first: str, last: str, most: int) -> DataFrame:
    """Each range in the fewest chunks of at most ``most`` pages, as even as can be: 22 pages by 10 are 8, 7 and 7."""
    rows = ranges.select("*", F.posexplode(_evenly(F.col(first), F.col(last), most)).alias("chunk", "_c"))
    return rows.withColumns({"chunk": F.col("chunk").cast("long"), "chunk_first": F.col("_c.first"), "chunk_last": F.col("_c.last")}).drop("_c")


#: A context window's margin, what is taken of it beforehand and by each chunk, tokens of a page, and pages at least and at most.
MARGIN, TAKEN, TAKEN_BY_CHUNK, PAGE_TOKENS, LEAST_PAGES, MOST_PAGES = 0.10, 50_000, 15_000, 800 * 1.5, 3, 15


def safe_chunk_pages(context_window: Column, most: int | None = None) -> Column:
    """Pages of a chunk that a context window has room for."""
    room = F.floor(context_window * (1 - MARGIN)) - TAKEN - TAKEN_BY_CHUNK
    pages = F.greatest(F.lit(LEAST_PAGES), F.floor(room / PAGE_TOKENS))
    return F.least(pages, F.lit(min(most, MOST_PAGES) if most else MOST_PAGES))


#: Words of a slide that say what it is.
THANKS_WORDS = ("thank", "thanks", "q&a", "qa", "contact", "致谢", "谢谢", "感谢", "答疑", "联系方式")
CONTENTS_WORDS = ("agenda", "contents", "content", "outline", "目录", "议程", "目录页")
CHAPTER_WORDS = ("chapter", "part", "section", "章节", "部分")


def slide_role(index: Column, total: Column, text: Column, texts: Column, images: Column, shapes: Column) -> Column:
    """What a slide may be, by its words first (closing, contents, chapter), then by its place and how much is on it."""
    low = F.lower(text)
    roles = [
        (X.any_contained(low, THANKS_WORDS), "ending_candidate"), (X.any_contained(low, CONTENTS_WORDS), "toc_candidate"), (X.any_contained(low, CHAPTER_WORDS), "chapter_candidate"),
        ((index == 1) & (images <= 3), "cover_candidate"), ((index == total) & (texts <= 6), "ending_candidate"), ((texts <= 3) & (shapes <= 12), "chapter_candidate"),
    ]
    out = F.lit("content_candidate")
    for found, role in reversed(roles):
        out = F.when(found, role).otherwise(out)
    return out


def table_alignment(cells: DataFrame, keys: list[str], col: str, value: str) -> DataFrame:
    """(keys, col, numeric): a column is numeric if all its non-empty cells are."""
    number = F.col(value).rlike("^-?[0-9]+([.][0-9]+)?%?$")
    return cells.where(F.coalesce(value, F.lit("")) != "").groupBy(*keys, col).agg(F.min(number).alias("numeric"))


def _runs(rows: DataFrame, group: list[str], order: str, starts: Column, name: str = "_run") -> DataFrame:
    """Numbers runs of rows of a group in order; a row for which ``starts`` holds begins a new one."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_s", F.when(F.coalesce(starts, F.lit(True)), 1).otherwise(0)).withColumn(name, F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def _joined(rows: DataFrame, keys: list[str], order: str, text: str, by: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p[text]), by).alias(text), F.count("*").alias("lines"))


def joined_lines(lines: DataFrame, doc: str, order: str, text: str, heading: Column | None = None, item: Column | None = None) -> DataFrame:
    """Lines of a paragraph as one: a line goes on with the next unless it is empty or ends in ``.。!！?？:：;；``; headings and list items stand alone."""
    alone = F.coalesce(heading if heading is not None else F.lit(False), F.lit(False)) | F.coalesce(item if item is not None else F.lit(False), F.lit(False))
    rows = lines.withColumn("_alone", alone)
    w = Window.partitionBy(doc).orderBy(order)
    before = F.regexp_replace(F.lag(text).over(w), f"{X.BLANK}+$", "")
    ends = (before == "") | before.rlike("[.。!！?？:：;；]$") | F.col("_alone") | F.lag("_alone").over(w)
    return _joined(_runs(rows, [doc], order, ends), [doc, "_run"], order, text, " ").withColumnRenamed("_run", "block")


def code_islands(lines: DataFrame, doc: str, page: str, order: str, text: str, is_code: Column) -> DataFrame:
    """Consecutive code lines of a page as one fenced block; a page's end closes it."""
    rows = lines.withColumn("_code", is_code)
    w = Window.partitionBy(doc, page).orderBy(order)
    runs = _runs(rows, [doc, page], order, F.lag("_code").over(w) != F.col("_code")).where("_code")
    return _joined(runs, [doc, page, "_run"], order, text, "\n").select(doc, page, F.col("_run").alias("block"), F.concat(F.lit("```\n"), text, F.lit("\n```")).alias(text), "lines")


def note_sections(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, title, body): lines under the heading before them; sections of one title are joined in order."""
    w = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    heading = F.when(F.col(text).rlike("^#+ "), F.regexp_replace(text, "^#+ +", ""))
    rows = lines.withColumn("_h", heading).withColumn("title", F.last("_h", ignorenulls=True).over(w)).where("_h is null and title is not null")
    return _joined(rows, [doc, "title"], order, text, "\n")


def merged_headings(elements: DataFrame, doc: str, order: str, level: str, text: str, longest: int = 60) -> DataFrame:
    """Neighbouring headings of one level as one, as long as the result is short. A fold in order, by document; tasks take a batch of documents, a row of arrays each."""
    kinds, columns = dict(elements.dtypes), (order, level, text)
    by = elements.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(columns))))).alias("_rows"))

    def merged(rows: list[list]) -> list[list]:
        out = []
        for at, lev, line in sorted(rows, key=lambda row: row[0] is None):
            if out and (lev or 0) > 0 and out[-1][1] == lev and len(out[-1][2]) + 1 + len(line) <= longest:
                out[-1][2] += f" {line}"
            else:
                out.append([at, lev, line])
        return out

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            kind = lists.type.value_type
            fields = [c.to_pylist() for c in lists.flatten().flatten()]
            ends = np.cumsum(np.diff(lists.offsets.to_numpy())).tolist()
            found, owner, low = [], [], 0
            for n, high in enumerate(ends):
                rows = merged(list(zip(*(f[low:high] for f in fields), strict=True)))
                found += rows
                owner += [n] * len(rows)
                low = high
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *(pa.array([r[k] for r in found], kind.field(k).type) for k in range(3))], [doc, *columns])

    return by.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in (doc, *columns)))


def split_at_sections(sections: DataFrame, chapter: str, start: str, last: str, most: int, least: int = 3) -> DataFrame:
    """(chapter, first, last): a chapter of at most ``most`` pages whole; a longer one cut before the sections that would make a chunk as long as that, though not after under ``least`` pages; what is still too
    long evenly; a chunk of one page joins the one before it, or after.

    Each step is a fold over an array in the chapter's row.
    """
    by = sections.groupBy(chapter).agg(F.array_sort(F.collect_set(F.col(start).cast("long"))).alias("_s"), F.max(last).cast("long").alias("_end"))
    kind = "array<struct<first:bigint,last:bigint>>"
    chunk = lambda a, b: F.struct(a.cast("long").alias("first"), b.cast("long").alias("last"))
    rows = by.withColumn("_start", F.element_at("_s", 1)).withColumn("_n", F.col("_end") - F.col("_start") + 1)

    def cut(state: Column, section: Column) -> Column:
        ends = (section - state["at"] >= most) & (section - state["at"] >= least)
        return F.struct(F.when(ends, section).otherwise(state["at"]).alias("at"), F.when(ends, F.concat(state["done"], F.array(chunk(state["at"], section - 1)))).otherwise(state["done"]).alias("done"))

    begin = F.struct(F.col("_start").alias("at"), F.array().cast(kind).alias("done"))
    rows = rows.withColumn("_cut", F.aggregate("_s", begin, cut, lambda state: F.concat(state["done"], F.array(chunk(state["at"], F.col("_end"))))))
    # one chunk, or a chunk that is too long, is cut evenly
    rows = rows.withColumn("_even", F.flatten(F.transform("_cut", lambda c: F.when(c["last"] - c["first"] + 1 > most, _evenly(c["first"], c["last"], most)).otherwise(F.array(c)))))

    def join(state: Column, c: Column) -> Column:
        done, held = state["done"], state["held"]
        single, any_ = c["last"] == c["first"], F.size(done) > 0
        longer = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(chunk(F.element_at(done, -1)["first"], c["last"])))
        out = F.when(held.isNotNull(), F.concat(done, F.array(chunk(held, c["last"])))).when(single & any_, longer).when(single, done).otherwise(F.concat(done, F.array(c)))
        return F.struct(out.alias("done"), F.when(held.isNull() & single & ~any_, c["first"]).alias("held"))

    joined = F.aggregate("_even", F.struct(F.array().cast(kind).alias("done"), F.lit(None).cast("long").alias("held")), join, lambda state: state["done"])
    whole = (F.col("_n") <= most) | (F.size("_even") == 1)
    return rows.select(chapter, F.explode(F.when(whole, F.array(chunk(F.col("_start"), F.col("_end")))).otherwise(joined)).alias("_c")).select(chapter, "_c.first", "_c.last")


def gap_worth(blocks: Column, preferred: int = 0) -> Column:
    """Higher for a more natural number of blocks: most for 3, something for 2 to 5, little for 6 to 8; the number that was asked for is worth more. The numbers are fixed values."""
    worth = F.when(blocks.between(2, 5), 20 - F.abs(blocks - 3) * 3).when(blocks.between(6, 8), 10 - blocks).otherwise(0)
    return worth + (F.when(blocks == preferred, 5).otherwise(0) if preferred > 0 else F.lit(0))


def best_gap(counts: list[tuple[int, Column]], preferred: int = 0) -> Column:
    """Of candidate gaps, each with the number of blocks that it makes, the one of the greatest worth; the first of equal ones."""
    each = F.array(*[F.struct(gap_worth(n, preferred).cast("long").alias("worth"), F.lit(-k).alias("place"), F.lit(gap).alias("gap")) for k, (gap, n) in enumerate(counts)])
    return F.array_max(each)["gap"]


def balanced_blocks(blocks: DataFrame, slots: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, slot, text): a group's n blocks in its slots, from 1. Too many are joined in runs of ceil(n / slots) by a blank line; of too few the last one is in every slot that is left.

    ``slots``: (group, slots). Groups without blocks have no rows.
    """
    n = blocks.groupBy(group).agg(F.count("*").alias("_n"))
    at = F.row_number().over(Window.partitionBy(group).orderBy(order))
    runs = blocks.withColumn("_at", at).join(n.join(slots, group), group).withColumn("slot", F.when(F.col("_n") > F.col("slots"), F.ceil(F.col("_at") / F.ceil(F.col("_n") / F.col("slots")))).otherwise(F.col("_at")).cast("int"))
    joined = _joined(runs, [group, "slot"], order, text, "\n\n").drop("lines")
    every = n.join(slots, group).select(group, "_n", "slots", F.explode(F.sequence(F.lit(1), F.col("slots").cast("int"))).alias("slot"))
    every = every.withColumn("_from", F.when(F.col("_n") < F.col("slots"), F.least(F.col("slot"), F.col("_n"))).otherwise(F.col("slot")).cast("int"))
    return every.join(joined.withColumnRenamed("slot", "_from"), [group, "_from"], "left").select(group, "slot", F.coalesce(text, F.lit("")).alias(text))


def paragraph_map(old: DataFrame, new: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """(group, slot, order, old, new): the old paragraphs of each slot (group, slot, order, text) and what replaces them; those that stay as they are left out.

    A new text's paragraphs are its lines that aren't blank; what is over the old ones' number is joined to the last by ``；``; where there are fewer, the last old ones stay.
    """
    lines = F.filter(F.transform(F.split(F.replace(text, F.lit("\\n"), F.lit("\n")), "\n"), X.strip), lambda x: x != "")
    fresh = new.select(group, "slot", lines.alias("_new"))
    place = F.row_number().over(Window.partitionBy(group, "slot").orderBy(order))
    rows = old.withColumn("_at", place).join(old.groupBy(group, "slot").agg(F.count("*").alias("_n")), [group, "slot"]).join(fresh, [group, "slot"])
    rest = F.array_join(F.slice("_new", F.col("_at"), F.greatest(F.lit(1), F.size("_new"))), "；")
    own = F.when((F.col("_at") == F.col("_n")) & (F.size("_new") > F.col("_n")), rest).otherwise(F.try_element_at("_new", F.col("_at")))
    return rows.select(group, "slot", order, F.col(text).alias("old"), own.alias("new")).where("new is not null and old != new")


#: A character's width and a line's height in sizes of type; EMU of an inch.
CHARACTER, LINE, INCH = 0.55, 1.4, 914_400.0


def slot_capacity(width: Column, height: Column, size: Column) -> Column:
    """Characters that a box (in EMU) has room for at a size of type (in points, 12 if null): characters of a line times lines, one of each at least; 0 without width or size."""
    points, wide, high = F.coalesce(size.cast("double"), F.lit(12.0)), F.coalesce(width, F.lit(0)) / INCH, F.coalesce(height, F.lit(0)) / INCH
    across = F.greatest(F.lit(1), F.floor(wide * 72 / (points * CHARACTER)))
    lines = F.when(high > 0, F.greatest(F.lit(1), F.floor(high / (points * LINE / 72)))).otherwise(1)
    return F.when((points <= 0) | (wide <= 0), 0).otherwise(across * lines).cast("long")


def assigned_slots(contents: DataFrame, slots: DataFrame, group: str, content: str, text: str, slot: str) -> DataFrame:
    """(group, slot, content, capacity, length, over): the longest text to the slot (capacity, top, left) of the most room, rank by rank; slots without a text have null.

    Slots of one capacity are in reading order, texts of one length in the order of their keys; ``over``: the text is longer than there is room.
    """
    w = lambda *order: F.row_number().over(Window.partitionBy(group).orderBy(*order))
    s = slots.withColumn("_r", w(F.desc("capacity"), "top", "left", slot))
    c = contents.select(group, content, F.length(text).cast("long").alias("length")).withColumn("_r", w(F.desc("length"), content))
    out = s.select(group, slot, "capacity", "_r").join(c, [group, "_r"], "left")
    return out.select(group, slot, content, "capacity", "length", F.coalesce(F.col("length") > F.col("capacity"), F.lit(False)).alias("over"))


def promoted(pool: DataFrame, group: str, key: str, chosen: DataFrame) -> DataFrame:
    """A pool with the chosen candidate of each group selected instead of the one before; others as they were."""
    c = chosen.select(group, F.col(key).alias("_chosen"))
    state = F.when(F.col("_chosen").isNull(), F.col("status")).when(F.col(key) == F.col("_chosen"), "promoted").when(F.col("status").isin("selected", "promoted"), "candidate").otherwise(F.col("status"))
    return pool.join(c, group, "left").withColumn("status", state).drop("_chosen")
