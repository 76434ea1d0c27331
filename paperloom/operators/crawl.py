"""Crawling as joins: references resolved by an expression, a frontier of addresses joined to the pages, level by level.

A page's links stay in its own row until they are chosen, so that the best folders of a page are found without a shuffle; what moves
is the next frontier only, without addresses that were visited before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..state import checkpointed

#: Endings of files that are looked for, and of addresses that are no folders.
WANTED = (".pptx", ".ppt")
FILES = (".pptx", ".ppt", ".pdf", ".docx", ".doc", ".xlsx", ".png", ".jpg", ".jpeg", ".gif", ".mp4", ".zip", ".html", ".htm", ".js", ".css")
#: Folders of a page that are visited, by name.
FOLDERS = 20


def without_dots(path: Column) -> Column:
    """An absolute path with ``.`` and ``..`` taken out; ``..`` at the top stays there."""
    parts = F.split(path, "/")

    def step(kept: Column, part: Column) -> Column:
        back = F.slice(kept, 1, F.greatest(F.lit(1), F.size(kept) - 1))
        return F.when(part == "..", back).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    open_end = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_end, F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolved(base: Column, ref: Column) -> Column:
    """The absolute address of a reference on a page: with a scheme, a host (``//h``), a root path, a query or fragment alone, or a relative path."""
    scheme = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.coalesce(F.nullif(F.regexp_extract(path, "^(.*/)", 1), F.lit("")), F.lit("/"))
    of_ref, rest = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
    plain, query = F.regexp_extract(base, "^([^?#]*)", 1), F.regexp_extract(base, "^([^#]*)", 1)
    return (
        F.when(ref == "", base)
        .when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
        .when(ref.startswith("//"), F.concat(scheme, ref))
        .when(ref.startswith("#"), F.concat(query, ref))
        .when(ref.startswith("?"), F.concat(plain, ref))
        .when(ref.startswith("/"), F.concat(origin, without_dots(of_ref), rest))
        .otherwise(F.concat(origin, without_dots(F.concat(folder, of_ref)), rest))
    )


def references(html: Column) -> Column:
    """The distinct references of a page's anchors, in order; those to the page itself and to scripts aside."""
    found = F.regexp_extract_all(html, F.lit("(?is)<a\\s[^>]*?href\\s*=\\s*[\"']([^\"']*)[\"']"), F.lit(1))
    return F.filter(F.array_distinct(found), lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("javascript:"))


def _ends(ref: Column, endings: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for e in endings:
        out = out | F.lower(ref).endswith(e)
    return out


def crawl(pages: DataFrame, seeds: DataFrame, url: str = "url", html: str = "html", keywords: tuple[str, ...] = (), depth: int = 2, wanted: tuple[str, ...] = WANTED, most: int = FOLDERS) -> DataFrame:
    """(seed, link, level): the wanted files that are linked on the pages of each seed, up to ``depth`` levels down, each at its first level.

    A file counts if its decoded address has one of the keywords, whatever the case. From a page, the first ``most`` folders below it by name are visited next; a folder is an
    address that ends like no file, or in a slash. An address is visited once for each seed. Pages that repeat an address are one, the greatest text of them.
    """
    p = pages.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("at")).agg(F.max(html).alias("_html"))
    frontier = checkpointed(seeds.where(F.col(url).isNotNull()).select(F.col(url).alias("seed"), F.col(url).alias("at")).distinct())
    visited, files = frontier, None
    for level in range(depth):
        links = F.transform(references(F.col("_html")), lambda ref: F.struct(ref.alias("ref"), resolved(F.col("at"), ref).alias("link")))
        there = frontier.join(p, "at").select("seed", "at", links.alias("links"))
        # '+' is no blank in an address
        name = lambda x: F.lower(F.coalesce(F.try_url_decode(F.replace(x["link"], F.lit("+"), F.lit("%2B"))), x["link"]))
        hits = lambda x: F.exists(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(name(x), k)) if keywords else F.lit(True)  # noqa: E731, B023
        own = F.filter("links", lambda x: _ends(x["ref"], wanted) & hits(x))
        under = F.regexp_replace("at", "/+$", "")
        below = F.filter("links", lambda x: ~_ends(x["ref"], wanted) & (~_ends(x["ref"], FILES) | x["ref"].endswith("/")) & x["link"].startswith(under))  # noqa: B023
        found = there.select("seed", F.explode(own).alias("x")).select("seed", F.col("x.link").alias("link"), F.lit(level).alias("level"))
        files = found if files is None else files.union(found)
        if level + 1 < depth:
            ahead = F.slice(F.array_sort(F.array_distinct(F.transform(below, lambda x: x["link"]))), 1, most)
            frontier = checkpointed(there.select("seed", F.explode(ahead).alias("at")).distinct().join(visited, ["seed", "at"], "left_anti"))
            visited = visited.union(frontier)
    return files.groupBy("seed", "link").agg(F.min("level").alias("level"))
