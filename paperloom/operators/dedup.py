"""Exact, greedy and geometric de-duplication.

Groups of copies may be large, so every choice of a representative is an aggregate that folds on the map
side (``min_by``), not a sort of the group. The greedy selection works on similarity edges only: rows
without an edge are kept at once, and rounds settle the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..state import checkpointed
from . import regions


def keep_first(rows: DataFrame, groups: list[str], order: Column, key: str) -> DataFrame:
    """(key, kept): the first row of each group by ``order`` is kept; rows with a null group always."""
    named = rows.select(*groups, key, F.struct(order, F.col(key)).alias("_o"))
    first = named.dropna(subset=groups).groupBy(*groups).agg(F.min("_o").alias("_first"))
    joined = named.join(first, groups, "left")
    return joined.select(key, F.coalesce(F.col("_o") == F.col("_first"), F.lit(True)).alias("kept"))


def shortest_path_entry(rows: DataFrame, group: str, path: str, order: str) -> DataFrame:
    """(group, first_key, path, copies): the shortest path of a group under the key that was seen first."""
    return rows.groupBy(group).agg(F.min_by(path, order).alias("first_key"), F.min_by(path, F.struct(F.length(path), F.col(order))).alias("path"), F.count("*").alias("copies"))


#: Rows of a block; two blocks meet in one matrix product. Cells that vectors are put into at most: their directions are sent to all tasks.
BLOCK, CELLS = 8192, 1024
#: Visitors of a block that are multiplied at once.
SLICE = 512
#: Bounds are widened by this share, as they are rounded.
SLACK = 1e-9


class Cells:
    """Directions, and how far the vectors of each one's cell reach along it and across."""

    def __init__(self, directions: np.ndarray):
        self.directions, n = directions, len(directions)
        self.low, self.high, self.across = np.full(n, np.inf), np.full(n, -np.inf), np.zeros(n)

    def placed(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length along each direction, what is left across it, the direction that is nearest) of each vector."""
        along = vectors @ self.directions.T
        across = np.sqrt(np.maximum((vectors * vectors).sum(1)[:, None] - along * along, 0))
        return along, across, along.argmax(1)

    def reached(self, along: np.ndarray, across: np.ndarray, threshold: float) -> np.ndarray:
        """Whether a vector's product with one of a cell's may be over the threshold: the part along the direction, and the product of what is left across it."""
        far = np.maximum(along * self.low, along * self.high) + across * self.across
        return far * (1 + SLACK) + SLACK > threshold


def _vectors(batch: pa.RecordBatch, column: int, width: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(batch.num_rows, width)


def cells_of(rows: DataFrame, width: int, n: int) -> tuple[Cells, dict[int, int]]:
    """(cells, rows of each): directions are those of ``n`` of the vectors, by a hash."""
    picked = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(n).collect()
    found = np.array([r.v for r in picked], float).reshape(len(picked), width)
    length = np.sqrt((found * found).sum(1, keepdims=True))
    cells = Cells(found / np.where(length > 0, length, 1))

    def measure(batches):
        m = len(cells.directions)
        counts, low, high, most = np.zeros(m, np.int64), np.full(m, np.inf), np.full(m, -np.inf), np.zeros(m)
        for batch in batches:
            along, across, home = cells.placed(_vectors(batch, 0, width))
            at = np.arange(len(home))
            counts += np.bincount(home, minlength=m)
            np.minimum.at(low, home, along[at, home])
            np.maximum.at(high, home, along[at, home])
            np.maximum.at(most, home, across[at, home])
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (np.arange(m), counts, low, high, most)], ["cell", "n", "low", "high", "across"])

    measured = rows.select("v").mapInArrow(measure, "cell long, n long, low double, high double, across double")
    sizes = {}
    for r in measured.groupBy("cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("across").alias("across")).collect():
        cells.low[r.cell], cells.high[r.cell], cells.across[r.cell], sizes[r.cell] = r.low, r.high, r.across, r.n
    return cells, sizes


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, most_cells: int = CELLS) -> DataFrame:
    """(i, j) with i < j whose inner product is over the threshold, exactly, whatever the threshold.

    A vector is at home in the cell of the direction nearest to it. x.y is the product of their parts along a direction plus that of what is left across it, which is no more than
    the product of the two residual norms; so a vector visits only the cells (of higher numbers than its own) where its parts and the cell's reach
    may come over the threshold, and a pair meets in the later one's cell. The higher the threshold, the fewer the visits: at a low one of vectors without clusters, every vector visits
    every cell, as in any exact join of such data. A cell's homes and visitors are cut into blocks; a pair of blocks is one matrix product in a task, whatever the cell's size. Rows are shuffled
    as often as blocks meet them, and nothing is a product of tables. Null vectors, and those of another length than the first by hash, have no pairs.
    """
    # floats are moved as floats, and multiplied as doubles
    kind = dict(vectors.dtypes)[vector] if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    rows = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), (F.col(vector) if kind == "array<float>" else F.col(vector).cast("array<double>")).alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    if sizes is None:
        return rows.select(F.col("k").alias("i"), F.col("k").alias("j"))
    width = sizes.width
    rows = rows.where(F.size("v") == width)
    cells, at_home = cells_of(rows, width, min(most_cells, max(1, -(-sizes.n // block))))
    here = np.arange(len(cells.directions))

    def visits(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(home of each vector, cells that it visits, its own among them)."""
        along, across, home = cells.placed(matrix)
        return home, cells.reached(along, across, threshold) & (here > home[:, None]) | (here == home[:, None])

    def count(batches):
        total = np.zeros(len(here), np.int64)
        for batch in batches:
            total += visits(_vectors(batch, 0, width))[1].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(total)], ["cell", "n"])

    guests = {r.cell: r.n for r in rows.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()}
    home_blocks = np.array([-(-at_home.get(c, 0) // block) for c in here.tolist()])
    guest_blocks = np.array([-(-guests.get(c, 0) // block) for c in here.tolist()])

    def send(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            home, cell_of = visits(_vectors(batch, 1, width))
            part = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64)
            for is_home, row, cell in ((True, np.arange(len(keys)), home), (False, *np.nonzero(cell_of))):
                own, other = (home_blocks, guest_blocks) if is_home else (guest_blocks, home_blocks)
                times = other[cell]
                row, cell = np.repeat(row, times), np.repeat(cell, times)
                mine = part[row] % own[cell] if len(row) else row
                met = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                for low in range(0, len(row), 4096):
                    some = slice(low, low + 4096)
                    h, g = (mine[some], met[some]) if is_home else (met[some], mine[some])
                    taken = pa.array(row[some])
                    yield pa.RecordBatch.from_arrays([pa.array(cell[some]), pa.array(h), pa.array(g), pa.array(np.full(len(h), is_home)), pa.array(home[row[some]]), batch.column(0).take(taken), batch.column(1).take(taken)], ["cell", "h", "g", "is_home", "home", "k", "v"])

    def multiply(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_home, home, keys = (table.column(c).to_numpy() for c in ("is_home", "home", "k"))
        matrix = table.column("v").combine_chunks().flatten().to_numpy().astype(float, copy=False).reshape(len(keys), width)
        hosts, guests_at, found = np.flatnonzero(is_home), np.flatnonzero(~is_home), [(np.zeros(0, np.int64),) * 2]
        other = matrix[hosts].T
        for low in range(0, len(guests_at) if len(hosts) else 0, SLICE):
            some = guests_at[low : low + SLICE]
            x, y = np.nonzero(matrix[some] @ other > threshold)
            guest, host, same = keys[some[x]], keys[hosts[y]], home[some[x]] == home[hosts[y]]
            keep = (guest != host) & (~same | (guest < host))
            found.append((np.minimum(guest, host)[keep], np.maximum(guest, host)[keep]))
        i, j = map(np.concatenate, zip(*found, strict=True))
        return pa.table({"i": pa.array(i), "j": pa.array(j)})

    sent = rows.mapInArrow(send, f"cell long, h long, g long, is_home boolean, home long, k long, v {kind}")
    return sent.groupBy("cell", "h", "g").applyInArrow(multiply, "i long, j long")


def greedy_clusters(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, kept, cluster): vectors in order of key; one is kept unless a kept one before it is more similar than the threshold. A cluster is named by the first kept one that absorbed its rows.

    Equal vectors that are that similar to themselves are folded first: the first one stands for all, and no other of them can be kept. So a group of copies adds no pairs.
    """
    v = F.col(vector)
    norm = F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    rows = vectors.select(key, vector, F.when(v.isNotNull() & (norm > threshold), v).alias("_same"))
    firsts = rows.where("_same is not null").groupBy("_same").agg(F.min(key).alias("_first"))
    named = checkpointed(rows.join(firsts, "_same", "left").select(key, vector, F.coalesce("_first", key).alias("_first")))
    single = named.where(F.col(key) == F.col("_first")).select(key, vector)
    edges = checkpointed(similar_pairs(single, threshold, key, vector))
    judged = checkpointed(greedy_keep(single, edges, key))
    owner = edges.join(judged.where("kept").select(F.col(key).alias("i")), "i").groupBy(F.col("j").alias(key)).agg(F.min("i").alias("_owner"))
    settled = judged.join(owner, key, "left").select(F.col(key).alias("_first"), F.col("kept").alias("_kept"), F.when(F.col("kept"), F.col(key)).otherwise(F.col("_owner")).alias("cluster"))
    return named.join(settled, "_first").select(key, (F.col("_kept") & (F.col(key) == F.col("_first"))).alias("kept"), "cluster")


def greedy_similar(vectors: DataFrame, threshold: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, kept) of :func:`greedy_clusters`."""
    return greedy_clusters(vectors, threshold, key, vector).select(key, "kept")


def greedy_keep(rows: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, kept): rows in order of key; a row is kept unless a kept row before it has an edge to it.

    An edge goes from the earlier row to the later, by any order; keys only name rows.
    The lexicographically first maximal independent set of the edges (i, j), i < j. In each round, rows
    whose earlier neighbours are all settled are settled; rounds are as many as the longest chain.
    """
    edges = checkpointed(edges.select("i", "j").distinct())
    state = checkpointed(edges.select(F.col("j").alias("k")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        # rows that are nobody's later neighbour are not in the state: they are kept
        states = state.select(F.col("k").alias("i"), F.col("kept").alias("ik"), F.lit(True).alias("later"))
        earlier = edges.join(states, "i", "left").withColumn("ik", F.when(F.col("later").isNull(), True).otherwise(F.col("ik")))
        verdict = earlier.groupBy(F.col("j").alias("k")).agg(F.max(F.when(F.col("ik"), 1).otherwise(0)).alias("absorbed"), F.max(F.when(F.col("ik").isNull(), 1).otherwise(0)).alias("waits"))
        new = state.join(verdict, "k").select("k", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("absorbed") == 1, False).when(F.col("waits") == 0, True).alias("kept"))
        state = checkpointed(new)
        if state.where("kept is null").isEmpty():
            break
    return rows.select(F.col(key)).join(state.withColumnRenamed("k", key), key, "left").select(key, F.coalesce("kept", F.lit(True)).alias("kept"))


def removal_statistics(kept: DataFrame) -> DataFrame:
    """One row of (kept, cluster): total, kept, removed, the removal rate in percent, how many clusters have more than one row, and the rows of the largest of them."""
    by = kept.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.when(F.col("kept"), 1).otherwise(0)).alias("k"))
    total, k = F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("k"), F.lit(0))
    rate = F.when(total > 0, (total - k) * 100.0 / total).otherwise(0.0)
    return by.agg(total.alias("total"), k.alias("kept"), (total - k).alias("removed"), rate.alias("removal_rate"), F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("clusters"), F.max(F.when(F.col("n") > 1, F.col("n"))).alias("largest"))


def cluster_sizes(kept: DataFrame) -> DataFrame:
    """(cluster, size) of the clusters of more than one row."""
    return kept.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")


#: Rows of a group from which on its pairs aren't all listed at once; listed pairs at a time.
LARGE_GROUP, PAIRS = 512, 1 << 21


def _linked(x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
    """The first row of each row's component, of one group: a search from each row that isn't reached yet."""
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if label[i] >= 0:
            continue
        label[i], todo = i, [i]
        while todo:
            at = todo.pop()
            near = np.flatnonzero((label < 0) & (np.abs(x - x[at]) + np.abs(y - y[at]) < distance))
            label[near] = i
            todo += near.tolist()
    return label


def linked_rows(start: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray, distance: float) -> np.ndarray:
    """The first row of each row's component by links nearer than ``distance``, for groups of ``sizes`` rows that begin at ``start``."""
    label = np.arange(len(x))
    for g in np.flatnonzero(sizes > LARGE_GROUP).tolist():
        rows = slice(start[g], start[g] + sizes[g])
        label[rows] = start[g] + _linked(x[rows], y[rows], distance)
    small = np.flatnonzero(sizes <= LARGE_GROUP)
    chunk = np.cumsum(sizes[small] ** 2) // PAIRS
    for some in np.split(small, np.flatnonzero(np.diff(chunk)) + 1):
        row = np.repeat(start[some], sizes[some]) + np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])
        first, n = np.repeat(start[some], sizes[some]), np.repeat(sizes[some], sizes[some])
        i = np.repeat(row, n)
        j = np.repeat(first, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        near = (i != j) & (np.abs(x[i] - x[j]) + np.abs(y[i] - y[j]) < distance)
        i, j = i[near], j[near]
        while True:
            before = label[row].copy()
            np.minimum.at(label, i, label[j])
            label[row] = label[label[row]]
            if (label[row] == before).all():
                break
    return label


def geometric_clusters(boxes: DataFrame, group: str, key: str, x: str, y: str, area: str, distance: float) -> DataFrame:
    """(group, key, cluster): single linkage by the centres' Manhattan distance; clusters by area, largest first.

    A group is one page's shapes, which are few: a row of arrays. Tasks cluster a batch of groups at once.
    """
    kinds = dict(boxes.dtypes)
    at = F.col(group)
    by = boxes.groupBy(at).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), F.col(area).cast("double").alias("a")))).alias("s"))

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            k, px, py, areas = lists.flatten().flatten()
            px, py, areas = (c.to_numpy(zero_copy_only=False) for c in (px, py, areas))
            start = np.cumsum(sizes) - sizes
            owner = np.repeat(np.arange(len(sizes)), sizes)
            label = linked_rows(start, sizes, px, py, distance)
            total = np.bincount(label, np.nan_to_num(areas), len(label))
            roots = np.flatnonzero(label == np.arange(len(label)))
            roots = roots[np.lexsort((roots, -total[roots], owner[roots]))]
            rank = np.zeros(len(label), np.int64)
            own = owner[roots]
            rank[roots] = np.arange(len(roots)) - np.searchsorted(own, own) + 1
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), k, pa.array(rank[label])], [group, key, "cluster"])

    return by.mapInArrow(run, f"{group} {kinds[group]}, {key} {kinds[key]}, cluster long")


#: Rectangles of a page up to which all are compared, without a grid.
FEW = 64


def contained_rectangles(rects: DataFrame, page: str, key: str, share: float = 0.9, cell: int = 16) -> DataFrame:
    """(i, j): of one page's rectangles (x, y, w, h), i covers ``share`` of j or more, over a half, and comes before it: larger, or as large with a lower key.

    What covers over half of a rectangle's area that way covers its centre, so j stands in its centre's cell of a grid, i in
    all cells that it touches, and only those that meet in one are compared. On a page of up to ``FEW`` all are, and none is in more than one row.
    """
    if share <= 0.75:
        raise ValueError("less than three quarters may be covered without the centre")
    r = rects.select(page, F.col(key).alias("k"), *(F.col(c).cast("double").alias(c) for c in "xywh"))
    r = r.join(r.groupBy(page).agg((F.count("*") <= FEW).alias("_few")), page)
    one = F.lit(0).cast("long")
    cells = lambda low, size: F.when(F.col("_few"), F.array(one)).otherwise(F.sequence(F.floor(F.col(low) / cell), F.floor((F.col(low) + F.col(size)) / cell)))
    centre = lambda low, size: F.when(F.col("_few"), one).otherwise(F.floor((F.col(low) + F.col(size) / 2) / cell))
    a = r.select(page, F.col("k").alias("i"), *(F.col(c).alias(f"a{c}") for c in "xywh"), F.explode(cells("x", "w")).alias("cx"), cells("y", "h").alias("cys"))
    a = a.select("*", F.explode("cys").alias("cy")).drop("cys")
    b = r.select(page, F.col("k").alias("j"), *(F.col(c).alias(f"b{c}") for c in "xywh"), centre("x", "w").alias("cx"), centre("y", "h").alias("cy"))
    across = "greatest(0, least(ax + aw, bx + bw) - greatest(ax, bx)) * greatest(0, least(ay + ah, by + bh) - greatest(ay, by))"
    first = "(aw * ah > bw * bh or (aw * ah = bw * bh and i < j))"
    return a.join(b, [page, "cx", "cy"]).where(f"{first} and {across} + 1e-9 >= {share} * bw * bh").select("i", "j")


#: What a figure must measure, its longest side to its shortest, and the share of itself or of a table that the two may have in common.
FIGURE_WIDTH, FIGURE_HEIGHT, FIGURE_AREA, FIGURE_ASPECT, TABLE_SHARE = 100, 80, 30_000, 8, 0.5


def figure_rectangles(rects: DataFrame, page: str, key: str, tables: DataFrame | None = None, cell: int = 16) -> DataFrame:
    """(page, key, place): the rectangles (x, y, w, h) that are figures, numbered in reading order: large and compact enough, no table (page, x, y, w, h), and nine tenths of them not in a larger one that stays."""
    w, h = F.col("w"), F.col("h")
    big = rects.where((w >= FIGURE_WIDTH) & (h >= FIGURE_HEIGHT) & (w * h >= FIGURE_AREA) & (F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1)) <= FIGURE_ASPECT))
    if tables is not None:
        sides = lambda d, *more: d.select(page, *more, F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
        area = lambda side: (F.col(f"{side}.x1") - F.col(f"{side}.x0")) * (F.col(f"{side}.y1") - F.col(f"{side}.y0"))
        both = regions.meeting(sides(big, key), sides(tables), page, cell).where(regions.overlap() > TABLE_SHARE * F.least(area("a"), area("b")))
        big = big.join(both.select(F.col(f"a.{key}").alias(key)).distinct(), key, "left_anti")
    big = checkpointed(big)
    kept = greedy_keep(big, contained_rectangles(big, page, key, cell=cell), key).where("kept")
    return big.join(kept, key, "left_semi").withColumn("place", F.row_number().over(Window.partitionBy(page).orderBy("y", "x", key))).select(page, key, "place")


#: Where a page's foot begins, in EMU, and under which size in points a text there is a footnote.
FOOT_TOP, FOOT_SIZE = 5_800_000, 12


def outliers(blocks: DataFrame, page: list[str], order: str, tokens: Column, top: Column | None = None, size: Column | None = None) -> DataFrame:
    """(page, order, sim, overall, outlier, critical): how like a page's other blocks each is, by the mean cosine of term frequencies, and all of them on average. Pages of three blocks or more.

    A footnote (low on the page, in small type) counts for the others but is no outlier itself. The sum over a block's peers is a product with the peers' sum: linear in the page's tokens.
    """
    keys = [*page, order]
    foot = F.coalesce((top > FOOT_TOP) & (size < FOOT_SIZE), F.lit(False)) if top is not None and size is not None else F.lit(False)
    rows = blocks.select(*keys, tokens.alias("_tokens"), foot.alias("_foot"))
    sizes = rows.groupBy(*page).agg(F.count("*").alias("_n")).where("_n >= 3")
    tf = term_frequencies(rows, keys, F.col("_tokens"))
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    unit = tf.join(norms, keys).select(*keys, "tok", (F.col("tf") / F.col("norm")).alias("u"))
    every = unit.groupBy(*page, "tok").agg(F.sum("u").alias("all"))
    sums = unit.join(every, [*page, "tok"]).groupBy(*keys).agg(F.sum(F.col("u") * (F.col("all") - F.col("u"))).alias("s"))
    m = rows.join(sizes, page).join(sums, keys, "left").select(*keys, "_foot", (F.greatest(F.coalesce("s", F.lit(0.0)), F.lit(0.0)) / (F.col("_n") - 1)).alias("sim"))
    g = m.withColumn("overall", F.avg("sim").over(Window.partitionBy(*page)))
    out = "not _foot and sim < 0.01 and overall > 0.02 and sim < 0.15 * overall"
    return g.selectExpr(*keys, "sim", "overall", f"{out} as outlier", f"{out} and (sim < 0.003 or (overall > 0.03 and sim < 0.05 * overall)) as critical")


def term_frequencies(rows: DataFrame, keys: list[str], tokens: Column) -> DataFrame:
    """(keys, tok, tf)."""
    return rows.select(*keys, F.explode(tokens).alias("tok")).groupBy(*keys, "tok").agg(F.count("*").alias("tf"))


def tf_cosine(tf: DataFrame, pairs: DataFrame, a: list[str], b: list[str], keys: list[str]) -> DataFrame:
    """``pairs`` with column sim: the cosine of two rows' term frequencies; 0 without a shared token.

    ``a`` and ``b`` name the pair's columns for the keys of the two rows. Only tokens of listed pairs
    are joined.
    """
    norms = tf.groupBy(*keys).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    left = pairs.join(tf.select(*[F.col(k).alias(c) for k, c in zip(keys, a, strict=True)], "tok", F.col("tf").alias("tfa")), a)
    dots = left.join(tf.select(*[F.col(k).alias(c) for k, c in zip(keys, b, strict=True)], "tok", F.col("tf").alias("tfb")), [*b, "tok"]).groupBy(*a, *[c for c in b if c not in a]).agg(F.sum(F.col("tfa") * F.col("tfb")).alias("dot"))
    out = pairs.join(dots, list(dict.fromkeys([*a, *b])), "left")
    out = out.join(norms.select(*[F.col(k).alias(c) for k, c in zip(keys, a, strict=True)], F.col("norm").alias("na")), a, "left")
    out = out.join(norms.select(*[F.col(k).alias(c) for k, c in zip(keys, b, strict=True)], F.col("norm").alias("nb")), b, "left")
    return out.withColumn("sim", F.coalesce(F.col("dot") / (F.col("na") * F.col("nb")), F.lit(0.0))).drop("dot", "na", "nb")
