"""Approximate nearest neighbours by cross-polytope hashing (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from wayfare.llm.common import finished, written

TABLES = 6
#: Rows on which the number of probes is fitted (those of least hash), and queries among them.
SAMPLE, SAMPLE_QUERIES = 4096, 256
#: Queries among them on which pairs of hashes are fitted.
PAIR_QUERIES = 32
#: Recall that the fit aims at, on the sample.
AIM = 0.95
#: Candidates, and queries, of a bucket that are compared at once; larger buckets are dealt out in blocks.
BLOCK = 8192
#: Hashes that a table may concatenate, and what a copy of a query costs in comparisons.
HASHES, COPY = (1, 2), 64
FOUND = "query_id long, vec_id long, score double"


def signs(tables: int, hashes: int, width: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).choice([-1.0, 1.0], (tables, hashes, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of each row; the width is a power of two.

    In two passes over factors of the width near its root, each of which is a product with a small matrix.
    """
    n, width = x.shape
    b = 1 << (width.bit_length() // 2)
    a = width // b
    y = (x.reshape(n * a, b) @ butterflies(b)).reshape(n, a, b)
    y = y.swapaxes(1, 2).reshape(n * b, a) @ butterflies(a)
    return y.reshape(n, b, a).swapaxes(1, 2).reshape(n, width) / np.sqrt(width)


@cache
def butterflies(width: int) -> np.ndarray:
    """The Hadamard matrix of a small width."""
    out = np.ones((1, 1))
    while len(out) < width:
        out = np.block([[out, out], [out, -out]])
    return out


def rotated(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Pseudo-rotation: three rounds of random signs and a Hadamard transform."""
    for round_ in sign:
        x = hadamard(x * round_)
    return x


def nearness(x: np.ndarray, sign: np.ndarray) -> list[np.ndarray]:
    """For each hash of a table, the coordinates of rows along all signed axes."""
    return [np.concatenate([turned, -turned], axis=1) for turned in (rotated(x, one) for one in sign)]


def bucket_of(x: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """The bucket of each row: its nearest signed axis, of every hash in turn."""
    out = np.zeros(len(x), np.int64)
    for along in nearness(x, sign):
        out = out * along.shape[1] + along.argmax(axis=1)
    return out


def rank_pairs(count: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ranks (from 0) that the ``count`` largest sums of two sorted lists can have: few beside all ``width`` squared."""
    first = np.arange(min(count, width))
    upto = np.minimum(count // (first + 1), width)
    return np.repeat(first, upto), np.concatenate([np.arange(n) for n in upto])


def probed(x: np.ndarray, sign: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` nearest buckets of each row (all, if there are fewer): those of the largest sum of coordinates along their axes.

    With two hashes a bucket that is among them has ranks r and s along either with (r + 1)(s + 1) <= count, so that
    only such pairs are looked at, for some rows at a time.
    """
    width = 2 * x.shape[1]
    count = min(count, width ** len(sign))
    if len(sign) == 1:
        pairs = None
    else:
        pairs = rank_pairs(count, width)
    step = max(1, (1 << 21) // (width if pairs is None else max(width, len(pairs[0]))))
    parts = []
    for at in range(0, len(x), step):
        along = nearness(x[at : at + step], sign)
        if pairs is None:
            parts.append(np.argpartition(-along[0], count - 1, axis=1)[:, :count])
            continue
        order = [np.argsort(-y, axis=1) for y in along]
        high = [np.take_along_axis(y, o, axis=1) for y, o in zip(along, order, strict=True)]
        best = np.argpartition(-(high[0][:, pairs[0]] + high[1][:, pairs[1]]), count - 1, axis=1)[:, :count]
        parts.append(np.take_along_axis(order[0], pairs[0][best], axis=1) * width + np.take_along_axis(order[1], pairs[1][best], axis=1))
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.int64)


def reached(along: list[np.ndarray], value: np.ndarray) -> np.ndarray:
    """How many buckets are as near to each row as each of its values (rows, values), or nearer; no list of all buckets is made."""
    last = np.sort(along[-1], axis=1)
    out = np.empty(value.shape, np.int64)
    for i, v in enumerate(value):
        left = v[:, None] if len(along) == 1 else v[:, None] - along[0][i][None]
        out[i] = (last.shape[1] - np.searchsorted(last[i], left, side="left")).sum(axis=1)
    return out


def bar_of(along: list[np.ndarray], count: int) -> np.ndarray:
    """A value for each row that its ``count`` nearest buckets reach, and few others: by bisection."""
    low, high = sum(y.min(axis=1) for y in along), sum(y.max(axis=1) for y in along)
    for _ in range(30):
        middle = (low + high) / 2
        enough = reached(along, middle[:, None])[:, 0] >= count
        low, high = np.where(enough, middle, low), np.where(enough, high, middle)
    return low


def lengths(x: np.ndarray) -> np.ndarray:
    """Euclidean lengths, scaled so that no square overflows or vanishes."""
    top = np.abs(x).max(axis=1, initial=0.0)
    top[top == 0] = 1.0
    return top * np.sqrt(((x / top[:, None]) ** 2).sum(axis=1))


def lifted(x: np.ndarray, longest: float, query: bool, flat: bool) -> np.ndarray:
    """Rows as unit vectors whose angles order inner products: the missing length is one more coordinate."""
    x = x.astype(float)
    norm = lengths(x)
    if flat:
        out = x / norm[:, None]
    elif query:
        out = np.hstack([x / norm[:, None], np.zeros((len(x), 1))])
    else:
        out = np.hstack([x / longest, np.sqrt(np.maximum(0, 1 - (norm / longest) ** 2))[:, None]])
    width = 1 << max(1, (out.shape[1] - 1).bit_length())
    return np.pad(out, ((0, 0), (0, width - out.shape[1])))


def fitted(x: np.ndarray, k: int, tables: int, longest: float, flat: bool, rows: int, every: int, aim: float = AIM) -> tuple[int, int]:
    """(hashes, probes) of a table with which ``aim`` of true neighbours within a sample are found, at the least cost.

    A query costs the rows in its buckets, of ``rows`` in all, and its copies: more hashes a table are worth their more
    copies where there are many rows, or close neighbours; where their copies alone cost more than one hash, no more is worked out.
    """
    if len(x) <= k + 1:
        return 1, 1 << 30
    q = x[: min(SAMPLE_QUERIES, len(x))].astype(float)
    score = q @ x.astype(float).T
    score[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argsort(-score, axis=1)[:, :k]
    base, asked = lifted(x, longest, False, flat), lifted(q, longest, True, flat)
    chosen = None
    for hashes in HASHES:
        some = slice(0, len(q) if hashes == 1 else PAIR_QUERIES)
        least, held = np.full(best[some].shape, 1 << 60), []
        for sign in signs(tables, hashes, base.shape[1]):
            own = [y.argmax(axis=1) for y in nearness(base, sign)]
            along = nearness(asked[some], sign)
            value = sum(np.take_along_axis(y, o[best[some]], axis=1) for y, o in zip(along, own, strict=True))
            # what rounding may take from a sum
            least = np.minimum(least, reached(along, value - 1e-12))
            held.append((own, along))
        probes = int(np.quantile(least, aim, method="higher"))
        if chosen is not None and tables * probes * COPY >= chosen[0]:
            continue
        share = np.mean([(sum(y[:, o] for y, o in zip(along, own, strict=True)) >= bar_of(along, probes)[:, None]).mean() for own, along in held])
        cost = tables * (share * rows + probes * COPY)
        if chosen is None or cost < chosen[0]:
            chosen = cost, hashes, probes
    return chosen[1:]


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def _hashed(dimension: int, hashes: int, probes: int, tables: int, longest: float, flat: bool, every: int):
    """Rows (tab, bucket, asks, vec_id, embedding): each row once by table, each query once more by probe."""
    schema = ["tab", "bucket", "asks", "vec_id", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch["embedding"], dimension), batch["vec_id"].to_numpy()
            asks = np.flatnonzero(ids % every == 0)
            base, asked = lifted(x, longest, False, flat), lifted(x[asks], longest, True, flat)
            for t, sign in enumerate(signs(tables, hashes, base.shape[1])):
                parts = [(np.arange(len(ids)), bucket_of(base, sign), False)]
                # copies of a few queries at a time, so that a batch stays small
                for at in range(0, len(asks), max(1, (1 << 16) // max(1, min(probes, 1 << 16)))):
                    some = slice(at, at + max(1, (1 << 16) // max(1, min(probes, 1 << 16))))
                    buckets = probed(asked[some], sign, probes)
                    parts.append((np.repeat(asks[some], buckets.shape[1]), buckets.ravel(), True))
                for rows, buckets, flag in parts:
                    taken = batch["embedding"].take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), t, np.int32)), pa.array(buckets.astype(np.int32)), pa.array(np.full(len(rows), flag)), pa.array(ids[rows]), taken],
                        names=schema,
                    )

    return run


def best(queries: np.ndarray, query_ids: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int):
    """(query_id, vec_id, score) arrays of each query's ``k`` nearest in a block, itself left out."""
    out = []
    base64, limit = base.astype(float), 1 << 22
    # what rounding may add to or take from a block's products
    slack = 8 * base64.shape[1] * np.finfo(float).eps * lengths(base64).max(initial=0.0)
    step = max(1, limit // max(1, len(base)))
    for at in range(0, len(queries), step):
        q = queries[at : at + step].astype(float)
        own = query_ids[at : at + step]
        score = q @ base64.T
        score[own[:, None] == base_ids[None]] = -np.inf
        if len(base) > k:
            bar = np.partition(score, len(base) - k, axis=1)[:, len(base) - k] - slack * lengths(q)
        else:
            bar = np.full(len(q), -np.finfo(float).max)
        i, j = np.nonzero((score >= bar[:, None]) & np.isfinite(score))
        # the same sum for the same vectors, whatever the block
        exact = np.concatenate([(q[i[a : a + 65536]] * base64[j[a : a + 65536]]).sum(axis=1) for a in range(0, len(i), 65536)] or [np.zeros(0)])
        order = np.lexsort((base_ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, i)
        kept = np.arange(len(i)) - first < k
        out.append((own[i[kept]], base_ids[j[kept]], exact[kept]))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def _ranked(dimension: int, k: int):
    """Exact reranking of the buckets of a partition, rows in order of bucket and candidates before queries."""

    def block(rows: pa.Table):
        asks = rows["asks"].to_numpy(zero_copy_only=False)
        x, ids = _matrix(rows["embedding"], dimension), rows["vec_id"].to_numpy()
        return best(x[asks], ids[asks], x[~asks], ids[~asks], k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = Merged(k)
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            names = [batch[n].to_numpy() for n in ("tab", "bucket", "salt")]
            new = np.flatnonzero(np.any([x[1:] != x[:-1] for x in names], axis=0)) + 1
            for a, b in zip([0, *new], [*new, batch.num_rows], strict=True):
                own = tuple(int(x[a]) for x in names)
                if key is not None and own != key:
                    merged.add(*block(pa.Table.from_batches(held)))
                    held = []
                    if merged.rows > 1 << 21:
                        yield merged.taken()
                key = own
                held.append(batch.slice(a, b - a))
        if held:
            merged.add(*block(pa.Table.from_batches(held)))
        yield merged.taken()

    return run


class Merged:
    """Each query's ``k`` nearest over blocks."""

    def __init__(self, k: int):
        self.k, self.parts, self.rows = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.rows += len(columns[0])
        if len(self.parts) > 64:
            self.merge()

    def merge(self) -> None:
        q, v, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        fresh = np.r_[True, (q[1:] != q[:-1]) | (v[1:] != v[:-1])] if len(q) else np.zeros(0, bool)
        q, v, s = q[fresh], v[fresh], s[fresh]
        kept = np.arange(len(q)) - np.searchsorted(q, q) < self.k
        self.parts = [(q[kept], v[kept], s[kept])]
        self.rows = int(kept.sum())

    def taken(self) -> pa.RecordBatch:
        if self.parts:
            self.merge()
        q, v, s = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.parts, self.rows = [], 0
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows that take part: an id, and a finite, non-zero vector without null components."""
    single = vectors.schema[vector_col].dataType == ArrayType(FloatType(), vectors.schema[vector_col].dataType.containsNull)
    x = vectors[vector_col] if single else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), x.alias("embedding"))
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("embedding", lambda v: v != 0)
    )


def nearest(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, tables: int = TABLES
) -> DataFrame:
    """The ``k`` rows of largest inner product with each query: (query_id, rank, vec_id, score).

    Queries are the rows whose id is divisible by ``every``; candidates are all others than the query's own
    id.  Vectors are lifted to unit length so that angles order inner products, and hashed to the
    nearest signed axes after pseudo-rotations.  A query probes the nearest buckets of each table; the number
    of hashes and of probes is fitted on a bounded sample, which (being sparser) asks for more than all rows do.  Every
    row is indexed and each bucket's candidates are reranked exactly, in double precision.  A query that has found fewer
    than ``k`` while there are more candidates is run against all rows in blocks.

    Single-precision vectors stay so, others are taken in double precision.  Rows with a null id, a null, zero or
    non-finite vector, or a dimension other than the most frequent (the
    larger, if tied) take no part; of rows that repeat an id the least vector counts.  An empty table gives an empty
    result.  Other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    rows = written(rows, "vectors")
    size = F.size("embedding")
    common = rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dimension, total = common["d"], common["count"]
    whole, rows = rows, rows.where(size == dimension)
    top = F.array_max(F.transform("embedding", F.abs)).cast("double")
    norm = top * F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, v: a + (v.cast("double") / top) * (v.cast("double") / top)))
    low, longest = rows.agg(F.min(norm), F.max(norm)).first()
    flat = low > longest * (1 - 1e-6)
    sample = rows.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("embedding").toArrow()
    hashes, probes = fitted(_matrix(sample["embedding"], dimension), k, tables, longest, flat, total, every)
    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"tab int, bucket int, asks boolean, vec_id long, embedding {kind}"
    hashed = rows.mapInArrow(_hashed(dimension, hashes, probes, tables, longest, flat, every), schema)
    # buckets with many candidates or queries are blocks of both: each candidate meets each query in one of them
    def blocks(which: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.count(F.when(which, 1)) / BLOCK)).cast("int")

    parts = hashed.groupBy("tab", "bucket").agg(blocks(~F.col("asks")).alias("down"), blocks(F.col("asks")).alias("across"))
    parts = written(parts.where("down > 1 or across > 1"), "buckets")
    parted = hashed.join(parts, ["tab", "bucket"], "left")
    down, across = F.coalesce("down", F.lit(1)), F.coalesce("across", F.lit(1))
    mine = F.xxhash64("vec_id")
    salts = F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), down - 1), lambda i: i * across + F.pmod(mine, across).cast("int"))).otherwise(
        F.transform(F.sequence(F.lit(0), across - 1), lambda j: F.pmod(mine, down).cast("int") * across + j)
    )
    dealt = parted.withColumn("salt", F.explode(salts)).select("tab", "bucket", "salt", "asks", "vec_id", "embedding")
    dealt = dealt.repartition("tab", "bucket", "salt").sortWithinPartitions("tab", "bucket", "salt", "asks")
    found = finished(dealt.mapInArrow(_ranked(dimension, k), FOUND), "found", parts)
    queries = rows.where(F.col("vec_id") % every == 0)
    held = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"))
    short = queries.join(held, F.col("vec_id") == F.col("query_id"), "left").where(
        F.coalesce("n", F.lit(0)) < min(k, total - 1)
    )
    short = written(short.select("vec_id", "embedding"), "short")
    every_one = found.unionByName(exhaustive(short, rows, dimension, k)) if short.head(1) else found
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = every_one.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", F.row_number().over(first))
    return finished(ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest", whole, found, short)


def exhaustive(queries: DataFrame, rows: DataFrame, dimension: int, k: int) -> DataFrame:
    """``queries`` against all ``rows``, block by block: both are dealt out in parts of BLOCK rows at most."""
    down, across = (-(-x.count() // BLOCK) for x in (rows, queries))
    mine = F.xxhash64("vec_id")
    base = rows.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda j: F.pmod(mine, F.lit(down)) * across + j)).alias("salt"), F.lit(False).alias("asks"), "vec_id", "embedding")
    asked = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda i: i * across + F.pmod(mine, F.lit(across)))).alias("salt"), F.lit(True).alias("asks"), "vec_id", "embedding")
    both = base.unionByName(asked).select(F.lit(0).alias("tab"), F.lit(0).alias("bucket"), F.col("salt").cast("int").alias("salt"), "asks", "vec_id", "embedding")
    return both.repartition("salt").sortWithinPartitions("salt", "asks").mapInArrow(_ranked(dimension, k), FOUND)
