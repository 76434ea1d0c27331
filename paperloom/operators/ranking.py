"""A user's ranking function as a Python table function: called with a query and rows of the index, its results filled up, sorted and cut to k.

``rank(query, rows)`` gets a list of dicts and returns some dicts, each with as many of the result's fields as it likes. It sees an index in chunks of ``CHUNK`` rows,
where the index lies: its rows aren't shuffled and go to Python once for all queries; of every partition the best k go on, whose best k are the result. A function that fails on a chunk raises.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: The result's fields and what they are where a ranking function doesn't say.
DEFAULTS = {"file": "", "title": "", "slide_num": 1, "text_preview": "", "score": 0.0, "path_abs": ""}
_KINDS = {str: StringType(), int: LongType(), float: DoubleType()}
CHUNK = 1000

Rank = Callable[[str, list[dict]], list[dict]]


def table_function(queries: list[str], rank: Rank, k: int, chunk: int = CHUNK):
    """The table function: of each partition of a table, the best k results of each query, the first of equal ones by all their fields."""

    class Ranked:
        def __init__(self):
            self.rows, self.best = [], {q: [] for q in queries}

        @staticmethod
        def analyze(index: AnalyzeArgument) -> AnalyzeResult:
            if not index.isTable:
                raise ValueError("a table is needed")
            schema = StructType().add("query", StringType())
            for name, value in DEFAULTS.items():
                schema = schema.add(name, _KINDS[type(value)])
            return AnalyzeResult(schema=schema)

        def _rank(self) -> None:
            for query, best in self.best.items():
                for result in rank(query, [dict(r) for r in self.rows]) or ():
                    full = tuple(type(v)(result[n]) if result.get(n) is not None else v for n, v in DEFAULTS.items())
                    best.append((-full[list(DEFAULTS).index("score")], full))
                best[:] = heapq.nsmallest(k, best)
            self.rows = []

        def eval(self, index: Row):
            self.rows.append(index.asDict())
            if len(self.rows) >= chunk:
                self._rank()

        def terminate(self):
            if self.rows:
                self._rank()
            for query, best in self.best.items():
                for _, full in best:
                    yield (query, *full)

    return F.udtf(Ranked)


def ranked(index: DataFrame, queries: list[str], rank: Rank, k: int, parts: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(query, place, file, title, slide_num, text_preview, score, path_abs): the best k results of each query, from 1. ``parts``: partitions to deal the index to first, if it isn't to be taken as it lies."""
    if parts:
        index = index.repartition(parts)
    best = table_function(queries, rank, k, chunk)(index.asTable())
    # k rows of each part
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), *(n for n in DEFAULTS if n != "score")))
    return best.withColumn("place", place).where(F.col("place") <= k).select("query", "place", *DEFAULTS)
