"""Removal of long repeated byte strings (operator 4).

Every byte covered by a ``length``-byte string that also starts anywhere else in
the corpus is removed.  A complete induced suffix sort carries one tuple for
every byte of text, many times the disk that a job may use, so only *sampled*
suffixes are named, sorted and counted by Spark, and the verdict for every other
position is induced from its sample:

1. Sample.  Of the ``gram``-byte strings in each window of ``length`` bytes, the
   one with the least hash (leftmost on ties) is the window's sample.  The choice
   depends on the window's bytes alone, so equal windows have equal samples.
2. Name.  Consecutive windows that share a sample form a *stretch*.  A stretch is
   named by (hash of its sample, hash of all its bytes); a name that occurs twice
   proves all of its windows repeated.  Counting is one partial aggregation.
3. Induce.  A stretch with a name of its own, whose sample occurs elsewhere, holds
   windows that may be repeated or not (the ends of shared passages).  It, and one
   stretch of each other name with that sample, is cut into parts of a few windows
   at fixed distances from the sample; parts are named and counted in the same way.
   The bytes that all windows of a part have in common are its core: a part whose core
   does not occur in a part of another name has no repeated window.  What stays open
   recurses down to parts of one window.

No step gathers a group: hot samples and hot names are only counted (with partial
aggregation) and joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import finished, forget, small_batches, written

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
PIECE = 1 << 19  # bytes that are hashed at once; must stay below 2**POSITION_BITS
POSITION_BITS = 21


class Rolling:
    """Polynomial hashes modulo 2**64 of all strings of a buffer, from prefix sums."""

    def __init__(self, seed: int, capacity: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1 << 60, 1 << 62)) * 8 + 5
        self.up = _powers(base, capacity)
        self.down = _powers(pow(base, -1, 1 << 64), capacity)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def all_of(self, prefix: np.ndarray, size: int) -> np.ndarray:
        """Hashes of the strings of ``size`` bytes that start at 0, 1, ..."""
        n = len(prefix) - size
        return _mixed((prefix[size:] - prefix[:n]) * self.down[:n])


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the well-mixed high bits of a product over all 64."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` neighbours, from block-wise running minima."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, MASK, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def pieces(sizes: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (row, start, end) of at most about PIECE bytes that hold each window of each text once."""
    held: list[tuple[int, int, int]] = []
    total = 0
    for row, size in enumerate(sizes):
        start = 0
        while size - start >= length:
            end = min(size, start + PIECE - length)
            if total + end - start > PIECE:
                yield held
                held, total = [], 0
            held.append((row, start, end))
            total += end - start
            start = end - length + 1
    if held:
        yield held


STRETCH = "id long, fp long, h long, c long, n int, lo int, hi int, at int"
PART = "id long, fp long, h long, c long, lo int, hi int, at int, lone boolean, data binary"
#: Windows in a part, level by level.
PARTS = (12, 1)
_ROLLING: list[Rolling] = []


def _rolling() -> Rolling:
    if not _ROLLING:
        _ROLLING.append(Rolling(7, PIECE + 1))
    return _ROLLING[0]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Offsets and bytes of an Arrow column of strings or binaries without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, memoryview(column.buffers()[2] or b"")


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]
    arrays = [
        pa.array(x.view(np.int64) if isinstance(x, np.ndarray) and x.dtype == np.uint64 else x).cast(kind)
        for x, kind in zip(columns, types, strict=True)
    ]
    return pa.RecordBatch.from_arrays(arrays, names=names)


def stretches_of(data: bytes, sizes: list[int], length: int, gram: int) -> list[np.ndarray]:
    """(text, sample hash, content hash, first window, last window, sample) of texts laid end to end."""
    position = np.uint64((1 << POSITION_BITS) - 1)
    rolling, view = _rolling(), memoryview(data)
    grams = rolling.all_of(rolling.prefix(np.frombuffer(data, np.uint8)), gram)
    keys = (grams & ~position) | np.arange(len(grams), dtype=np.uint64)
    least = (sliding_least(keys, length - gram + 1) & position).astype(np.int64)
    begin, out = 0, []
    for text, size in enumerate(sizes):
        own = least[begin : begin + size - length + 1]
        lo = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        hi = np.r_[lo[1:], len(own)] - 1
        spans = zip((lo + begin).tolist(), (hi + begin + length).tolist(), strict=True)
        names = np.array([xxhash.xxh3_64_intdigest(view[x:y]) for x, y in spans], np.uint64)
        out.append((np.full(len(lo), text), grams[own[lo]], names, lo, hi, own[lo] - begin))
        begin += size
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _stretches(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch["text"])
            ids, prints = (batch[x].to_numpy(zero_copy_only=False) for x in ("id", "fp"))
            for group in pieces(np.diff(offsets), length):
                rows, starts, ends = map(np.array, zip(*group, strict=True))
                held = b"".join([data[offsets[r] + s : offsets[r] + e] for r, s, e in group])
                text, h, c, lo, hi, at = stretches_of(held, (ends - starts).tolist(), length, gram)
                # neighbours of one name, as in periodic text, are one row
                new = np.r_[True, (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (text[1:] != text[:-1])]
                first = np.flatnonzero(new)
                last = np.r_[first[1:], len(h)] - 1
                row, start = rows[text[first]], starts[text[first]]
                place = lo[first] + start, hi[last] + start, at[first] + start
                yield _batch(STRETCH, ids[row], prints[row], h[first], c[first], last - first + 1, *place)

    return run


def _slices(length: int):
    """The bytes of open stretches, each as one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch["text"])
            out: list[tuple] = []
            for i, (doc, print_, spans) in enumerate(zip(*(batch[x].to_pylist() for x in ("id", "fp", "spans")), strict=True)):
                base = int(offsets[i])
                for x in spans:
                    held = bytes(data[base + x["lo"] : base + x["hi"] + length])
                    out.append((doc, print_, x["h"], 0, x["lo"], x["hi"], x["at"], x["lone"], held))
            if out:
                yield _batch(PART, *zip(*out, strict=True))

    return run


def _name(data: bytes, seed: int = 0) -> int:
    name = xxhash.xxh3_64_intdigest(data, seed & 0xFFFFFFFFFFFFFFFF)
    return name - (name >> 63 << 64)


def _parts(length: int, size: int):
    """Cuts parts into parts of ``size`` windows that begin at fixed distances from the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            columns = [batch[x].to_pylist() for x in ("id", "fp", "lo", "hi", "at", "lone", "data")]
            for doc, print_, lo, hi, at, lone, data in zip(*columns, strict=True):
                for b in range((lo - at) // size, (hi - at) // size + 1):
                    begin = at + b * size
                    x, y = max(lo, begin), min(hi, begin + size - 1)
                    held = data[x - lo : y - lo + length]
                    # the distance goes into the core's name: only parts at one distance are compared
                    core = _name(data[begin + size - 1 - lo : begin + length - lo], b)
                    out.append((doc, print_, core, _name(held), x, y, at, lone, held if size > 1 else b""))
            if out:
                yield _batch(PART, *zip(*out, strict=True))

    return run


def _cut(length: int):
    """Merges the windows of each text into runs of bytes, and takes those out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes_of(batch["text"])
            lists = batch["spans"].combine_chunks() if isinstance(batch["spans"], pa.ChunkedArray) else batch["spans"]
            runs, kept = [], []
            for i, spans in enumerate(lists):
                text, own = bytes(data[offsets[i] : offsets[i + 1]]), []
                for lo, hi in sorted((x["lo"], x["hi"] + length) for x in spans.as_py() or ()):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], hi)
                    else:
                        own.append([lo, hi])
                edges = [0, *(e for x in own for e in x), len(text)]
                kept.append(b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)))
                runs.append([{"start": x, "end": y} for x, y in own])
            span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(np.diff(offsets)), pa.array(runs, pa.list_(span)), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[id_col].cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(text, docs[id_col].isNull()).alias("fp"),
        text.alias("text"),
    )


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 64
) -> DataFrame:
    """Takes out each byte covered by a ``length``-byte string that starts more than once in the corpus.

    Returns a row for each row: doc_id, n_bytes, removed (maximal runs of bytes, end
    exclusive), kept (the remaining bytes).  A null text counts as empty, a text
    shorter than ``length`` has nothing to remove, rows that repeat a text (with the
    same id or another, or none) repeat all its strings, and an empty table gives an
    empty result.  Columns besides ``id_col`` and ``text_col`` are not looked at.
    """
    small_batches(docs.sparkSession)
    keyed = _keyed(docs, id_col, text_col)
    long_enough = keyed.where(F.octet_length("text") >= length)
    rid = F.xxhash64("id", "fp", "lo")
    stretches = written(long_enough.select("id", "fp", "text").mapInArrow(_stretches(length, gram), STRETCH), "stretches")
    samples = (
        stretches.groupBy("h")
        .agg(F.sum("n").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1"))
        .where("n > 1")
        .select("h", (F.col("c0") == F.col("c1")).alias("one_name"))
    )
    # counts are written before they are joined, so that joins may split hot samples and names
    samples = written(samples, "samples")
    found = written(stretches.join(samples, "h"), "found")
    forget(stretches, samples)
    mixed = found.where("not one_name").withColumn("rid", rid)
    names = written(mixed.groupBy("h", "c").agg(F.sum("n").alias("copies"), F.min("rid").alias("first")), "names")
    mixed = mixed.join(names, ["h", "c"])
    place = ["id", "fp", "lo", "hi"]
    covered = written(found.where("one_name").select(place).unionByName(mixed.where("copies > 1").select(place)), "covered")
    lone = F.col("copies") == 1
    wanted = (
        mixed.where(lone | (F.col("rid") == F.col("first")))
        .groupBy("id", "fp")
        .agg(F.collect_set(F.struct("h", "lo", "hi", "at", lone.alias("lone"))).alias("spans"))
    )
    # lists by text are written too, so that the joins with whole texts may split a text that very many rows repeat
    wanted = written(wanted, "wanted")
    open_ = long_enough.select("id", "fp", "text").join(wanted, ["id", "fp"]).mapInArrow(_slices(length), PART)
    read, spans = [found, names, wanted], [covered]
    for size in PARTS:
        parts = written(open_.mapInArrow(_parts(length, size), PART), "parts")
        forget(*read)
        names = written(
            parts.withColumn("rid", rid).groupBy("h", "c").agg(F.count(F.lit(1)).alias("copies"), F.min("rid").alias("first")), "names"
        )
        read = [parts, names]
        repeated = parts.where("lone").join(names.where("copies > 1").select("h", "c"), ["h", "c"]).select(place)
        spans.append(written(repeated, "covered"))
        covered = covered.unionByName(spans[-1])
        several = names.groupBy("h").agg(F.count(F.lit(1)).alias("names")).where("names > 1").select("h")
        rest = parts.withColumn("rid", rid).join(names.join(several, "h"), ["h", "c"])
        rest = rest.where(lone | (F.col("rid") == F.col("first")))
        open_ = rest.select(*[F.col(x.split()[0]) for x in PART.split(", ")[:-2]], (lone & F.col("lone")).alias("lone"), "data")
    forget(*read)
    by_text = finished(covered.groupBy("id", "fp").agg(F.collect_set(F.struct("lo", "hi")).alias("spans")), "by-text", *spans)
    schema = "doc_id long, n_bytes long, removed array<struct<start:int,end:int>>, kept binary"
    return keyed.join(by_text, ["id", "fp"], "left").select("doc_id", "text", "spans").mapInArrow(_cut(length), schema)
