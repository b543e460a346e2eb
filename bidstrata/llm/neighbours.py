"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector to the cell floor((a·v + b) / width) along each of a few Gaussian directions. A query visits its
own cell and then perturbed ones, one step to either side along some directions, in the order in which a near vector is
expected there: by the sum of squared distances from the query to the borders that must be crossed. The order of sets of
borders is the same for every query once its borders are sorted, so it is made once. Candidates of all tables meet their
query cell by cell, are compared exactly, and the nearest of each cell are merged.

Number of directions, cell width and number of probes are fitted: exact neighbours of a few queries, taken over all
rows, say what share of them each setting finds, a sample of rows what it costs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidstrata.llm.common import doc_starts, releasing, spread, stored

#: Rows and probes of a cell compared in one task; a larger cell is dealt out in blocks of so many each.
BLOCK = 128
#: Numbers that one step of a comparison holds.
COMPARED = 1 << 19
#: Cells dealt out in blocks are listed: each holds more than a so-manieth of all rows or probes, so the list is bounded.
MAX_HOT = 100_000
#: Settings tried: directions a table, and cell widths in units of the median distance to a query's farthest neighbour.
DIRECTIONS, WIDTHS, MOST_PROBES = (2, 3, 4, 6, 8, 12, 16, 20), (0.5, 1.0, 1.5, 2.0, 3.0), 256
#: What a probe costs, in comparisons.
PROBE_COST = 30


def probe_order(directions: int, most: int) -> np.ndarray:
    """(probe, border): which of a query's ``2 * directions`` borders, sorted by distance, each probe crosses.

    Probes rise by their expected score, the sum of the borders' expected squared distances; the first crosses none.
    Both borders of one direction, the j-th nearest and the j-th farthest, are never crossed together.
    """
    m = directions
    near = [j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(1, m + 1)]
    far = [1 - j / (m + 1) + j * (j + 1) / (4 * (m + 1) * (m + 2)) for j in range(m, 0, -1)]
    z = near + far
    found, waiting = [()], [(z[0], (0,))]
    while waiting and len(found) < most:
        score, borders = heapq.heappop(waiting)
        if not any(2 * m - 1 - x in borders for x in borders):
            found.append(borders)
        last = borders[-1]
        if last + 1 < 2 * m:
            heapq.heappush(waiting, (score - z[last] + z[last + 1], (*borders[:-1], last + 1)))
            heapq.heappush(waiting, (score + z[last + 1], (*borders, last + 1)))
    out = np.zeros((len(found), 2 * m), bool)
    for k, borders in enumerate(found):
        out[k, list(borders)] = True
    return out


@dataclass(frozen=True)
class Hashing:
    """The tables of an index and how many cells of each a query visits. Same arguments, same tables."""

    dimensions: int
    tables: int
    directions: int
    width: float
    probes: int
    seed: int = 7

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Directions, offsets, and odd factors that turn steps along the directions, and the table, into one number."""
        rng = np.random.default_rng([self.seed, self.directions, k])
        names = rng.integers(0, 1 << 63, self.directions + 1, dtype=np.uint64) | np.uint64(1)
        return rng.standard_normal((self.dimensions, self.directions)), rng.random(self.directions), names[:-1], names[-1:]

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table): each vector's cell in each table, as a long. Different cells of all tables share one only by
        a 64-bit coincidence, which costs a comparison."""
        out = np.empty((len(vectors), self.tables), np.uint64)
        for k in range(self.tables):
            a, b, names, table = self._table(k)
            step = np.floor(vectors @ a / self.width + b).astype(np.int64).view(np.uint64)
            out[:, k] = (step * names).sum(axis=1) + table
        return out.view(np.int64)

    def visits(self, vectors: np.ndarray) -> np.ndarray:
        """(row, table, probe): the cells a query visits, likeliest first."""
        order = probe_order(self.directions, self.probes)
        out = np.empty((len(vectors), self.tables, len(order)), np.uint64)
        home = self.cells(vectors).view(np.uint64)
        for k in range(self.tables):
            a, b, names, _ = self._table(k)
            at = vectors @ a / self.width + b
            below = at - np.floor(at)
            borders = np.argsort(np.concatenate([below, 1 - below], axis=1), axis=1, kind="stable")
            step = np.concatenate([np.uint64(0) - names, names])[borders]
            for p, crossed in enumerate(order):
                out[:, k, p] = home[:, k] + step[:, crossed].sum(axis=1, dtype=np.uint64)
        return out.view(np.int64)


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 0))


def distances(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, from the differences themselves; of one query (a vector) or of several
    ((query, 1, dimension) for (query, row))."""
    apart = vectors - query
    return np.sqrt((apart * apart).sum(axis=-1))


# --- input ----------------------------------------------------------------------------------------

def usable(vector: Column) -> Column:
    """Whether a vector can take part: not null, not zero, no null or non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _vectors(rows: DataFrame, name: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part."""
    named = rows.select(F.col(name).alias("id"), F.col(vector).alias("vector")).where(
        F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = named.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return named.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))


def _distinct(rows: DataFrame, keep: int) -> DataFrame:
    """(rep, vector, ids): each different vector, its least id, and its ``keep`` least ids. Copies need no comparing, and
    none but these can be among a query's nearest. Every task passes on no more than ``keep`` rows of a vector."""
    nth = Window.partitionBy("vector").orderBy("id")
    first = rows.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= keep)
    return first.groupBy("vector").agg(F.min("id").alias("rep"), F.sort_array(F.collect_set("id")).alias("ids"))


# --- search ---------------------------------------------------------------------------------------

def _hashed(df: DataFrame, hashing: Hashing, probe: bool) -> DataFrame:
    """A row for each cell that a row of ``df`` (rep, vector, …) lies in or, as a query, visits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                vectors = _matrix(part.column("vector"))
                cells = hashing.visits(vectors).reshape(len(vectors), -1) if probe else hashing.cells(vectors)
                for block in np.array_split(cells, max(1, cells.shape[1] // 16), axis=1):
                    if block.shape[1]:
                        again = part.take(pa.array(np.repeat(np.arange(len(vectors)), block.shape[1])))
                        yield again.append_column("cell", pa.array(block.ravel()))

    return df.mapInArrow(releasing(run), T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())]))


def _dealt(rows: DataFrame, probes: DataFrame, block: int) -> DataFrame:
    """Rows and probes of each cell together as (cell, row_block, probe_block, rep, vector, ids), ``ids`` null in probes.

    Of a cell with more than ``block`` rows or probes every block of rows meets every block of probes, each in a place of
    its own: no row or probe is left out, and no place holds more than about ``block`` of either.
    """
    both = rows.select("cell", "rep", "vector", "ids").unionByName(
        probes.select("cell", "rep", "vector", F.lit(None).cast(rows.schema["ids"].dataType).alias("ids")))
    sizes = both.groupBy("cell").agg(F.count("ids").alias("rows"), F.count_if(F.col("ids").isNull()).alias("probes"))
    total = sizes.agg(F.sum(F.col("rows") + F.col("probes"))).scalar()
    large = F.greatest("rows", "probes") > F.greatest(F.lit(block), total / MAX_HOT)
    hot = sizes.where(large & (F.col("rows") > 0) & (F.col("probes") > 0)).selectExpr(
        "cell AS hot", f"ceil(rows / {block}) AS row_blocks", f"ceil(probes / {block}) AS probe_blocks")
    placed = both.join(F.broadcast(hot), F.col("cell") == F.col("hot"), "left")
    mine = F.xxhash64("rep")
    one = lambda n: F.array(F.pmod(mine, F.col(n)))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    is_row, whole = F.col("ids").isNotNull(), F.array(F.lit(0).cast("bigint"))
    return (
        placed.withColumn("row_block", F.explode(
            F.when(F.col("hot").isNull(), whole).when(is_row, one("row_blocks")).otherwise(every("row_blocks"))))
        .withColumn("probe_block", F.explode(
            F.when(F.col("hot").isNull(), whole).when(is_row, every("probe_blocks")).otherwise(one("probe_blocks"))))
        .select("cell", "row_block", "probe_block", "rep", "vector", "ids")
    )


class _Nearest:
    """The nearest found so far of the queries of one task, given out before they grow large."""

    def __init__(self, keep: int, most: int = 200_000) -> None:
        self.keep, self.most, self.found = keep, most, []
        self.size = 0

    def add(self, queries: np.ndarray, score: np.ndarray, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """``score``: (query, row); row k has the ids from ``starts[k]`` on, ``lengths[k]`` of them. What ties with the last
        one kept is kept too, so that ids decide."""
        if score.shape[1] > self.keep:
            near = score <= np.partition(score, self.keep - 1, axis=1)[:, self.keep - 1:self.keep]
        else:
            near = np.ones(score.shape, bool)
        query, row = np.nonzero(near)
        n = lengths[row]
        self.found.append((np.repeat(queries[query], n), np.repeat(score[near], n), ids[spread(starts[row], n)]))
        self.size += int(n.sum())

    def taken(self) -> pa.RecordBatch:
        query, score, ids = (np.concatenate(x) for x in zip(*self.found, strict=True))
        order = np.lexsort((ids, score, query))
        query, score, ids = query[order], score[order], ids[order]
        new = np.concatenate([[True], (np.diff(query) != 0) | (np.diff(ids) != 0) | (np.diff(score) != 0)])
        query, score, ids = query[new], score[new], ids[new]
        starts = np.flatnonzero(np.concatenate([[True], np.diff(query) != 0]))
        nth = np.arange(len(query)) - np.repeat(starts, np.diff([*starts, len(query)]))
        best = nth < self.keep
        self.found, self.size = [], 0
        return pa.RecordBatch.from_arrays(
            [pa.array(query[best]), pa.array(score[best]), pa.array(ids[best])], ["rep", "score", "id"])


def _compare(keep: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a place come before its probes: the former are held, the latter compared as they pass."""
    nearest = _Nearest(keep)
    place, held, vectors, ids = None, [], None, ()
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("cell", "row_block", "probe_block")])
        cuts = [0, *(np.flatnonzero(np.any(np.diff(keys), axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b == a:
                continue
            if (now := tuple(keys[:, a])) != place:
                place, held, vectors, ids = now, [], None, ()
            part = batch.slice(a, b - a)
            n_rows = part.num_rows - part.column("ids").null_count
            if n_rows:
                held.append(part.slice(0, n_rows))
            if n_rows == part.num_rows or not held:
                continue  # no probe here yet, or no row of the index at all
            if vectors is None:
                vectors = np.concatenate([_matrix(x.column("vector")) for x in held])
                lists = pa.concat_arrays([x.column("ids") for x in held])
                lengths = lists.value_lengths().to_numpy().astype(np.int64)
                ids = (lists.flatten().to_numpy(), doc_starts(lengths), lengths)
            probes = part.slice(n_rows)
            queries, asked = probes.column("rep").to_numpy(), _matrix(probes.column("vector"))
            step = max(1, COMPARED // vectors.size)
            for at in range(0, len(queries), step):
                nearest.add(queries[at:at + step], distances(asked[at:at + step, None], vectors), *ids)
                if nearest.size > nearest.most:
                    yield nearest.taken()
    if nearest.size:
        yield nearest.taken()


def _search(rows: DataFrame, probes: DataFrame, keep: int, block: int) -> DataFrame:
    """(rep, score, id): for each query the ``keep`` nearest ids among rows that share a cell with one of its probes."""
    places = ["cell", "row_block", "probe_block"]
    dealt = _dealt(rows, probes, block).repartition(*places).sortWithinPartitions(*places, F.col("ids").isNull(), "rep")
    id_type = rows.schema["ids"].dataType.elementType
    found = dealt.mapInArrow(releasing(partial(_compare, keep)), T.StructType([
        rows.schema["rep"], T.StructField("score", T.DoubleType()), T.StructField("id", id_type)]))
    merged = found.groupBy("rep", "id").agg(F.min("score").alias("score"))
    nth = Window.partitionBy("rep").orderBy("score", "id")
    return merged.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= keep).drop("_nth")


# --- fitting --------------------------------------------------------------------------------------

def _exact(rows: DataFrame, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of a few queries its ``k`` nearest vectors of another place, from one pass over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[float, list[float]]]] = [[] for _ in queries]
        for batch in batches:
            for at in range(0, batch.num_rows, 4_096):
                vectors = _matrix(batch.column("vector").slice(at, 4_096))
                for q, query in enumerate(queries):
                    score = distances(query, vectors)
                    score[score == 0] = np.inf
                    near = np.argpartition(score, min(k, len(score)) - 1)[:k]
                    best[q] = heapq.nsmallest(
                        k, [*best[q], *((score[i], vectors[i].tolist()) for i in near if score[i] < np.inf)])
        yield pa.RecordBatch.from_pylist(
            [{"query": q, "score": s, "near": v} for q, found in enumerate(best) for s, v in found],
            pa.schema([("query", pa.int64()), ("score", pa.float64()), ("near", pa.list_(pa.float64()))]))

    nth = Window.partitionBy("query").orderBy("score", "near")
    found = rows.select("vector").mapInArrow(run, "query bigint, score double, near array<double>")
    got = found.withColumn("_nth", F.row_number().over(nth)).where(F.col("_nth") <= k).collect()
    return [np.array([r["near"] for r in got if r["query"] == q]) for q in range(len(queries))]


def fit_hashing(
    rows: DataFrame, queries: DataFrame, k: int, recall: float = 0.96, tables: int = 4, sample_queries: int = 128,
    sample_rows: int = 2_048, seed: int = 7,
) -> Hashing | None:
    """The cheapest setting that finds a share of ``recall`` of the exact neighbours of ``sample_queries`` queries.

    The neighbours come from one pass over all ``rows``; cost is estimated on ``sample_rows`` rows. Both samples are the
    bounded parameters given here, chosen by hash. If no setting reaches ``recall``, the best one is taken. No queries or
    no two different vectors: None.
    """
    def sample(df: DataFrame, n: int) -> np.ndarray:
        return np.array([r["vector"] for r in df.orderBy(F.xxhash64("rep", F.lit(seed)), "rep").limit(n).select("vector").collect()], float)

    asked, some, n_rows = sample(queries, sample_queries), sample(rows, sample_rows), rows.count()
    if not len(asked) or n_rows < 2:
        return None
    near = _exact(rows, asked, k)
    owner = np.repeat(np.arange(len(asked)), [len(x) for x in near])
    near = np.concatenate([x.reshape(-1, asked.shape[1]) for x in near])
    unit = float(np.median([distances(asked[q], near[owner == q]).max() for q in np.unique(owner)]))
    best = None
    for directions in DIRECTIONS:
        for width in WIDTHS:
            hashing = Hashing(asked.shape[1], tables, directions, width * unit, MOST_PROBES, seed)
            visited, own, others = hashing.visits(asked), hashing.cells(near), hashing.cells(some)
            # Which probe finds a row first, over all tables; MOST_PROBES if none does.
            first = np.full(len(near), MOST_PROBES)
            costs = np.zeros(MOST_PROBES + 1)
            for t in range(tables):
                for q in range(len(asked)):
                    cells, at = np.unique(visited[q, t], return_index=True)
                    for found, into in ((own[owner == q, t], first), (others[:, t], None)):
                        place = np.minimum(np.searchsorted(cells, found), len(cells) - 1)
                        nth = np.where(cells[place] == found, at[place], MOST_PROBES)
                        if into is None:
                            costs += np.bincount(nth, minlength=MOST_PROBES + 1)
                        else:
                            into[owner == q] = np.minimum(into[owner == q], nth)
            reached = np.cumsum(np.bincount(first, minlength=MOST_PROBES + 1)[:-1]) / len(first)
            compared = np.cumsum(costs[:-1]) / len(asked) / len(some) * n_rows
            cost = compared + PROBE_COST * tables * np.arange(1, MOST_PROBES + 1)
            enough = np.flatnonzero(reached >= recall)
            probes = int(enough[0]) if len(enough) else MOST_PROBES - 1
            ranked = (not len(enough), -reached[probes] if not len(enough) else 0, cost[probes])
            if best is None or ranked < best[0]:
                best = ranked, Hashing(asked.shape[1], tables, directions, width * unit, probes + 1, seed)
    return best[1]


# --- operator -------------------------------------------------------------------------------------

def nearest(
    rows: DataFrame, queries: DataFrame, name: str = "vec_id", vector: str = "embedding", k: int = 10,
    hashing: Hashing | None = None, block: int = BLOCK, **fit,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each query, all if there are fewer, nearest first,
    ties to the smaller id. The score is the Euclidean distance, in double precision.

    ``queries`` are some of ``rows`` and both have a number ``name`` and a numeric array ``vector``; further columns are
    ignored. A row of a query's own id is not a candidate. Rows take no part whose id is null, whose vector is null, zero
    or holds null or non-finite components, or whose vector has another length than most (ties: the shortest). Rows of
    equal id count once, at their least distance; copies of a vector are compared once and all counted. No usable rows or
    queries give no rows.

    ``hashing`` is fitted if not given (``fit_hashing``, which takes ``fit``). A query that finds fewer than it should is
    compared with all rows, in blocks, so hashing never decides how many rows it gets.
    """
    keep = k + 1  # the query itself is among them
    used = stored(_vectors(rows, name, vector))
    asked = used.join(_vectors(queries, name, vector).select("id").distinct(), "id", "left_semi").distinct()
    distinct = stored(_distinct(used, keep))
    asked = stored(asked.join(distinct.select("vector", "rep"), "vector").select("id", "rep"))
    probed = stored(distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "vector"))
    hashing = hashing or fit_hashing(distinct.select("rep", "vector"), probed, k, **fit)
    whole = lambda df: df.withColumn("cell", F.lit(0).cast("bigint"))
    if hashing is None:
        found = _search(whole(distinct), whole(probed), keep, block)
    else:
        found = stored(_search(_hashed(distinct, hashing, False), _hashed(probed, hashing, True), keep, block))
        ids = distinct.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
        full = found.groupBy("rep").agg(F.count("id").alias("_n")).where(F.col("_n") >= min(keep, ids))
        short = stored(probed.join(full, "rep", "left_anti"))
        if short.limit(1).count():
            found = found.join(short.select("rep"), "rep", "left_anti").unionByName(
                _search(whole(distinct), whole(short), keep, block))
    pairs = asked.withColumnRenamed("id", "query_id").join(found, "rep").where(F.col("query_id") != F.col("id"))
    pairs = pairs.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    nth = Window.partitionBy("query_id").orderBy("score", "id")
    return pairs.withColumn("rank", F.row_number().over(nth)).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(name), "score")
