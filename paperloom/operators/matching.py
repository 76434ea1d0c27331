"""Tiered matching of titles and texts, with a substring join by rare q-grams.

A needle stands in a haystack only if all of its q-grams do. Each needle is joined to haystacks by its rarest q-gram alone, and what meets is verified. A
needle of fewer than ``Q`` characters is a gram of its own. Which gram is the rarest is counted over one haystack in ``SAMPLED``, by a hash:
the choice decides how much is verified, never what is found. All is plain joins on grams, so frequent ones can be split by the engine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..state import stored
from .joins import first_tier, unique_matches

Q, SAMPLED = 4, 16
#: Bytes of the filters that keep other grams from being joined; they only spare work, and with over some 10^5 needles none.
PLACES = 1 << 16


def grams(text: Column, q: int) -> Column:
    """Hashes of the distinct windows of q characters of a text, found in one pass."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1)), lambda g: F.xxhash64(g)))


def _places(hashes: DataFrame, column: str) -> Column:
    """A filter of ``PLACES`` bytes, whatever the number of hashes: 1 at the places that hashes fall on."""
    out = bytearray(PLACES)
    for r in hashes.select(F.expr(f"cast({column} & {PLACES - 1}L as int)").alias("p")).distinct().collect():
        out[r.p] = 1
    return F.lit(bytes(out))


def _may_be(places: Column):
    """Whether a hash may be in the filter."""
    return lambda g: F.substring(places, g.bitwiseAND(F.lit(PLACES - 1)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")


def containing(needles: DataFrame, needle: str, haystacks: DataFrame, haystack: str, q: int = Q) -> DataFrame:
    """(needle, haystack), each once: the texts of which the second contains the first; empty needles stand nowhere.

    Haystacks go on as rows only with grams that may be some needle's rarest.
    """
    n = stored(needles.select(F.col(needle).alias("_n")).where("_n != ''").distinct())
    h = haystacks.select(F.col(haystack).alias("_h")).where("_h is not null")
    sizes = sorted(r[0] for r in n.select(F.least(F.length("_n"), F.lit(q))).distinct().collect())  # q at most
    if not sizes:
        return n.select(F.col("_n").alias(needle), F.col("_n").alias(haystack)).where("false")
    own = reduce(lambda a, k: F.when(F.length("_n") == k, grams(F.col("_n"), k)).otherwise(a), sizes, grams(F.col("_n"), q))
    parts = n.select("_n", F.explode(own).alias("_g"))
    every = lambda rows, places: rows.select("_h", F.explode(F.array_distinct(F.concat(*[F.filter(grams(F.col("_h"), k), _may_be(places)) for k in sizes]))).alias("_g"))
    sampled = h.where(F.pmod(F.xxhash64("_h"), F.lit(SAMPLED)) == 0)
    often = every(sampled, _places(parts, "_g")).groupBy("_g").agg(F.count("*").alias("_often"))
    rare = stored(parts.join(often, "_g", "left").groupBy("_n").agg(F.min_by("_g", F.struct(F.coalesce("_often", F.lit(0)), F.col("_g"))).alias("_g")))
    return every(h, _places(rare, "_g")).join(rare, "_g").where(F.contains("_h", F.col("_n"))).select(F.col("_n").alias(needle), F.col("_h").alias(haystack)).distinct()


def match_titles(titles: DataFrame, title: str, key: str, stems: DataFrame, stem: str, other: str) -> DataFrame:
    """(key, other, tier): each title's stem. Tiers: the same text; the same normalised; the same leading number; contained in the normalised stem; the last three if one stem fits only.

    Of stems with the same text the first one is it. 0 and null: none.
    """
    of = lambda rows, c: rows.withColumns({"_exact": F.col(c), "_norm": F.nullif(X.normalized_title(F.col(c)), F.lit("")), "_num": X.leading_number(F.col(c))})
    t, s = stored(of(titles.select(key, title), title)), stored(of(stems.select(other, stem), stem))
    exact = t.join(s.groupBy("_exact").agg(F.min(other).alias(other)), "_exact").select(key, other)
    tiers = [exact, unique_matches(t, s, key, other, "_norm"), unique_matches(t, s, key, other, "_num")]
    # only titles without a match so far look for their text in others
    left = stored(t.where(F.col("_norm").isNotNull()).join(reduce(DataFrame.unionByName, [x.select(key) for x in tiers]), key, "left_anti").select(key, F.col("_norm").alias("_needle")))
    pairs = containing(left, "_needle", s, "_norm")
    sizes = s.where(F.col("_norm").isNotNull()).groupBy("_norm").agg(F.count("*").alias("_n"), F.min(other).alias(other))
    single = pairs.join(sizes, "_norm").groupBy("_needle").agg(F.sum("_n").alias("_n"), F.min(other).alias(other)).where("_n = 1")
    return first_tier(titles, key, [*tiers, left.join(single, "_needle").select(key, other)], other)


def match_replacements(texts: DataFrame, text: str, key: str, mapping: DataFrame, old: str, new: str, order: str, longer_than: int = 4) -> DataFrame:
    """(key, replaced, tier): each text's replacement by a map in its own order. Tiers: the old text itself; the first that is the same in half-width and single blanks;
    the first of over ``longer_than`` characters that stands in the text, every place of which is replaced. Null and 0: none.

    Texts are compared without outer blanks; empty ones have no replacement. Of equal old texts the last one's new text counts, at the place of the first.
    """
    m = mapping.groupBy(F.col(old).alias("_old")).agg(F.max_by(new, order).alias("_new"), F.min(order).alias("_at")).where("_old is not null")
    same = m.groupBy(X.half_width(F.col("_old")).alias("_norm")).agg(F.min_by("_new", "_at").alias("_second"))
    t = texts.select(key, F.coalesce(X.strip(F.col(text)), F.lit("")).alias("_t")).withColumn("_norm", F.when(F.col("_t") != "", X.half_width(F.col("_t"))))
    t = t.join(m.where("_old != ''").select(F.col("_old").alias("_t"), F.col("_new").alias("_first")), "_t", "left").join(same, "_norm", "left")
    pairs = containing(m.where(F.length("_old") > longer_than), "_old", t.where("_first is null and _second is null"), "_t").join(m, "_old")
    inside = pairs.groupBy("_t").agg(F.min_by(F.struct("_old", "_new"), "_at").alias("_m"))
    third = F.when(F.col("_first").isNull() & F.col("_second").isNull(), F.replace("_t", F.col("_m._old"), F.col("_m._new")))
    tier = F.when(F.col("_first").isNotNull(), 1).when(F.col("_second").isNotNull(), 2).when(third.isNotNull(), 3).otherwise(0)
    return t.join(inside, "_t", "left").select(key, F.coalesce("_first", "_second", third).alias("replaced"), tier.alias("tier"))
