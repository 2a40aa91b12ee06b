"""Exact top-k by inner product of integer vectors, with one safe cutoff for every list (operator 12)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import finished, forget, written

#: Into how many parts the dimensions are cut: a node keeps a list of local scores for each.
PARTS = 2
#: Rows that a node holds at most, and components; queries that meet them at once are as many.
BLOCK, COMPONENTS = 16384, 1 << 22
#: Nodes and blocks of queries at least, so that small tables run in parallel too.
NODES, BLOCKS = 4, 3
#: Local scores that are looked at together.
TILE = 1 << 21
FACTOR = 64.0
LISTED = "row long, lows array<long>, best array<long>"
COLLECTED = "row long, query_id long, vec_id long, score long"
RESULT = "query_id long, rank int, vec_id long, score long"


def pieces(dimension: int, parts: int = PARTS) -> list[slice]:
    """The dimensions of each part, in order; a part may have none."""
    cuts = [dimension * i // parts for i in range(parts + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(64 x) of every component, as doubles, which hold these integers exactly."""
    return np.floor(FACTOR * x.astype(float))


def local_scores(q: np.ndarray, x: np.ndarray, parts: int = PARTS) -> list[np.ndarray]:
    """The inner products of queries and rows over each part of the dimensions, exact.

    In doubles where no sum can reach 2**53, in long integers up to 2**60, else in Python's integers.
    """
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most >= 1 << 53:
        q, x = ((y.astype(np.int64) if most < 1 << 60 else np.vectorize(int, otypes=[object])(y)) if y.size else y for y in (q, x))
    return [q[:, s] @ x[:, s].T for s in pieces(q.shape[1], parts)]


class Cell:
    """The rows of one node beside one block of queries; rows in order of id, null ids last."""

    def __init__(self, rows: pa.Table):
        asks = rows["asks"].to_numpy(zero_copy_only=False)
        dimension = rows["dim"][0].as_py()
        x = whole(rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(len(asks), dimension)
        ids, own = rows["vec_id"], rows["row"].to_numpy()
        self.queries, self.asked = x[asks], own[asks]
        self.query_ids = ids.filter(pa.array(asks)).to_numpy(zero_copy_only=False).astype(np.int64)
        self.cutoffs = rows["cutoff"].filter(pa.array(asks)).to_pylist()
        base = np.flatnonzero(~asks)
        known = ids.is_valid().to_numpy(zero_copy_only=False)[base]
        numbers = ids.fill_null(0).to_numpy()[base]
        base = base[np.lexsort((numbers, ~known))]
        self.base, self.rows, self.ids = x[base], own[base], ids.take(pa.array(base)).combine_chunks()

    def tiles(self) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray]]:
        """Some queries at a time: their local scores of each part, and which row is a query's own."""
        step = max(1, TILE // max(1, len(self.base)))
        for at in range(0, len(self.queries), step):
            some = slice(at, at + step)
            yield some, local_scores(self.queries[some], self.base), self.asked[some][:, None] == self.rows[None]


def listed(k: int, sent: int) -> Callable[[Cell], Iterator[pa.RecordBatch]]:
    """First phase: the least local score of each part, and the ``sent`` best whole scores of what a node's lists of ``k`` hold."""

    def run(cell: Cell) -> Iterator[pa.RecordBatch]:
        if not len(cell.base):
            return
        for some, local, own in cell.tiles():
            lows = np.stack([x.min(axis=1) for x in local], axis=1)
            chosen = []
            for x in local:
                left = np.where(own, x.min() - 1, x)
                chosen.append(np.argpartition(-left, k - 1, axis=1)[:, :k] if k < left.shape[1] else np.broadcast_to(np.arange(left.shape[1]), left.shape))
            at = np.sort(np.concatenate(chosen, axis=1), axis=1)
            fresh = np.ones(at.shape, bool)
            fresh[:, 1:] = at[:, 1:] != at[:, :-1]
            fresh &= ~np.take_along_axis(own, at, axis=1)
            total = sum(np.take_along_axis(x, at, axis=1) for x in local)
            best = [np.sort(t[f])[::-1][:sent].astype(np.int64) for t, f in zip(total, fresh, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.asked[some]), pa.array(list(lows.astype(np.int64))), pa.array(best, pa.list_(pa.int64()))], names=["row", "lows", "best"]
            )

    return run


def collected(k: int) -> Callable[[Cell], Iterator[pa.RecordBatch]]:
    """Second and third phase: entries at or over the cutoff in a list, resolved where their bound allows the top ``k``."""

    def run(cell: Cell) -> Iterator[pa.RecordBatch]:
        for some, local, own in cell.tiles() if len(cell.base) else ():
            safe, *lows = (np.array(x, local[0].dtype) for x in zip(*cell.cutoffs[some], strict=True))
            over = safe - sum(lows)
            bars = [(low - (-over // len(local)))[:, None] for low in lows]
            seen = [x >= bar for x, bar in zip(local, bars, strict=True)]
            bound = sum(np.where(s, x, bar - 1) for s, x, bar in zip(seen, local, bars, strict=True))
            i, j = np.nonzero(np.logical_or.reduce(seen) & (bound >= safe[:, None]) & ~own)
            exact = sum(x[i, j] for x in local)
            enough = exact >= safe[i]
            i, j, exact = i[enough], j[enough], exact[enough].astype(np.int64)
            order = np.lexsort((j, -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, exact = i[kept], j[kept], exact[kept]
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell.asked[some][i]), pa.array(cell.query_ids[some][i]), cell.ids.take(pa.array(j)), pa.array(exact)],
                names=["row", "query_id", "vec_id", "score"],
            )

    return run


def by_cell(use: Callable[[Cell], Iterator[pa.RecordBatch]]):
    """Applies ``use`` to each cell of a partition, whose rows are in order of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            names = [batch[n].to_numpy() for n in ("dim", "node", "block")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                if a == b:
                    continue
                own = tuple(int(x[a]) for x in names)
                if key is not None and own != key:
                    yield from use(Cell(pa.Table.from_batches(held)))
                    held = []
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            yield from use(Cell(pa.Table.from_batches(held)))

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows (row, vec_id, dim, embedding) that take part, each with a number of its own."""
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | F.isnan(v.cast("double") * FACTOR * 0.0))
    return rows.where(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.monotonically_increasing_id().alias("row"), "vec_id", F.size("embedding").alias("dim"), "embedding"
    )


def exact_top(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20) -> DataFrame:
    """The ``k`` rows of largest integer inner product with each query: (query_id, rank, vec_id, score).

    Components x become floor(64 x).  Queries are the rows whose id is divisible by ``every``, candidates all others.  Rows are
    dealt out to nodes, and a node keeps for each query a list of local scores over either half of the dimensions;
    a candidate's score is the sum of its local ones.

    1. Nodes list their largest local scores and send the best whole scores among these, with the least of each list.  The
       k-th best of all that is sent can be no higher than the k-th best score: it is the safe cutoff.
    2. Cutoffs go out with the queries.  Over the least scores of all lists, a candidate that reaches the cutoff has
       an equal share of it in one list at least, so nodes collect the entries at or over that uniform threshold, and drop those
       whose bound (the threshold stands for a score not collected) stays below the cutoff.
    3. What is left is resolved: its scores are added up, and what reaches the cutoff is sent and ranked.

    A node has at most BLOCK rows and meets as many queries at once; only cutoffs, and about k scores and
    entries of a query, are shuffled besides.  Queries with fewer than ``k`` candidates have no cutoff and get all.

    Vectors that are null or hold null or non-finite components (or ones whose 64-fold is not finite) take no part; zero and empty
    ones do, and vectors only meet others of their dimension.  Each row is a query and a candidate of its own, also where
    ids repeat.  Null ids are candidates, last among ties, and no queries.  A score beyond a long raises.  An
    empty table gives an empty result.  Other columns are not looked at.
    """
    rows = written(usable(vectors, id_col, vector_col), "topk-rows")
    asks = F.col("vec_id") % every == 0
    count, asked, most = rows.agg(F.count(F.lit(1)), F.count_if(asks), F.max("dim")).first()
    size = min(BLOCK, max(1, COMPONENTS // max(1, most or 1)))
    nodes, blocks = max(NODES, -(-count // size)), max(BLOCKS, -(-asked // size))
    node, block = F.pmod(F.xxhash64("row"), F.lit(nodes)).cast("int"), F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)).cast("int")

    def dealt(queries: DataFrame) -> DataFrame:
        held = ["dim", "node", "block", "asks", "row", "vec_id", "embedding", "cutoff"]
        none = F.lit(None).cast("array<long>").alias("cutoff")
        base = rows.withColumns({"node": node, "asks": F.lit(False), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))}).select(*held[:-1], none)
        some = queries.withColumns({"block": block, "asks": F.lit(True), "node": F.explode(F.sequence(F.lit(0), F.lit(nodes - 1)))}).select(*held)
        return base.unionByName(some).repartition(nodes * blocks, "dim", "node", "block").sortWithinPartitions("dim", "node", "block", "asks")

    queries = rows.where(asks).withColumn("cutoff", F.lit(None).cast("array<long>"))
    sent = min(k, -(-4 * k // nodes))
    lists = written(dealt(queries).mapInArrow(by_cell(listed(k, sent)), LISTED), "topk-lists")
    lows = lists.groupBy("row").agg(*[F.min(F.col("lows")[i]).alias(f"low{i}") for i in range(PARTS)])
    ranked = Window.partitionBy("row").orderBy(F.desc("score"))
    safe = lists.select("row", F.explode("best").alias("score")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    least = [F.col(f"low{i}") for i in range(PARTS)]
    cutoffs = lows.join(safe, "row", "left").select("row", F.array(F.coalesce("score", sum(least[1:], least[0])), *least).alias("cutoff"))
    cutoffs = finished(cutoffs, "topk-cutoffs", lists)
    entries = dealt(rows.where(asks).join(cutoffs, "row")).mapInArrow(by_cell(collected(k)), COLLECTED)
    first = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = entries.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    out = written(ranked.select("query_id", "rank", "vec_id", "score"), "topk")
    forget(rows, cutoffs)
    return out
