"""What each of five filters does in every order that they can be applied in (operator 11)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import forget, small_batches, written

SPACE = re.compile(rb"[\x20\x09-\x0D]")

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
#: The filter of each step of each order.
LETTERS = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
#: What is counted at each of the 600 steps.
COUNTS = ("kept", "removed", "redundant", "good_lost", "toxic_lost")
#: Fields of a wide counter: every count of every step, then how many fail one filter only.
FIELDS = len(ORDERS) * STEPS * len(COUNTS) + STEPS
AUDIT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


#: Bytes that are capitals, symbols of filter D, and bytes that begin no code point.
CAPITALS, SYMBOLS, INNER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
#: Bytes of a text that are split into words at once.
SLICE = 1 << 20


def slices(text: bytes) -> Iterator[bytes]:
    """``text`` in parts of about SLICE bytes, each of which ends at white space."""
    at = 0
    while len(text) - at > SLICE:
        gap = SPACE.search(text, at + SLICE)
        if gap is None:
            break
        yield text[at : gap.start()]
        at = gap.start()
    yield text[at:]


def text_failures(text: bytes) -> int:
    """Bits 0 to 3: whether a text fails A (under 200 words), B (under half of the words distinct), C (over 2 % capitals), D (a symbol of #$%&*|).

    ``bytes.split`` cuts at the six ASCII white-space characters, as a run of anything else is a word.
    """
    count, distinct = 0, set()
    for piece in slices(text):
        words = piece.split()
        count += len(words)
        distinct.update(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    points = len(text.translate(None, INNER))
    failed = (count < 200, 100 * len(distinct) < 50 * count, 100 * capitals > 2 * points, len(text.translate(None, SYMBOLS)) < len(text))
    return sum(x << i for i, x in enumerate(failed))


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch["text"].to_pylist()
        bits = pa.array([text_failures(x) for x in texts], pa.int32())
        shas = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["part"], bits, shas], names=["doc_id", "part", "mask", "sha"])


def masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> tuple[DataFrame, list[DataFrame]]:
    """How many documents of a part share a mask: (part, mask, good, toxic, n), and the written tables that it reads.

    A text is known again by its SHA-256.  The least id of each text is found by partial aggregation, and a document is
    a copy (E) if it is another; both sides of that join carry the id besides the hash, so that no text is a hot key.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    slim = written(rows.mapInArrow(_judged, f"doc_id {kind}, part string, mask int, sha binary"), "audit-masks")
    firsts = slim.where("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    firsts = written(firsts.withColumn("first", F.lit(True)), "audit-firsts")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    marks = written(marks, "audit-marks")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    held = slim.join(firsts, ["sha", "doc_id"], "left").join(marks, "doc_id", "left")
    counted = held.groupBy(
        "part",
        (F.col("mask") + F.when(copy, 1 << 4).otherwise(0)).cast("int").alias("mask"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted, [slim, firsts, marks]


def outcomes(mask: int, good: bool, toxic: bool) -> np.ndarray:
    """0 or 1 for every field of a document that fails the filters of ``mask``."""
    fails = (mask >> LETTERS & 1).astype(bool)
    gone = np.cumsum(fails, axis=1) > 0
    removed = fails & (np.cumsum(fails, axis=1) == 1)
    steps = np.stack([~gone, removed, fails & ~removed, removed & good, removed & toxic], axis=2)
    alone = [mask == 1 << i for i in range(STEPS)]
    return np.concatenate([steps.ravel(), alone]).astype(np.uint8)


def packed(fields: np.ndarray, width: int) -> int:
    """One integer whose fields of ``width`` bytes each hold ``fields``, the first one lowest."""
    wide = np.zeros((len(fields), width), np.uint8)
    wide[:, 0] = fields
    return int.from_bytes(wide.tobytes(), "little")


def unpacked(total: int, width: int) -> np.ndarray:
    """The fields of a sum of ``packed`` integers."""
    wide = np.frombuffer(total.to_bytes(FIELDS * width, "little"), np.uint8).reshape(FIELDS, width)
    return np.pad(wide, ((0, 0), (0, 8 - width))).copy().view("<i8")[:, 0]


def field_width(most: int) -> int:
    """Bytes in which a count of up to ``most`` fits."""
    return max(1, -(-most.bit_length() // 8))


def _summed(rows: pa.Table) -> pa.Table:
    """The audit of one part: its masks' integers, each as often as documents have the mask, added up and unpacked."""
    counts = rows["n"].to_pylist()
    width = field_width(sum(counts))
    total = 0
    for mask, good, toxic, n in zip(rows["mask"].to_pylist(), rows["good"].to_pylist(), rows["toxic"].to_pylist(), counts, strict=True):
        total += n * packed(outcomes(mask, good, toxic), width)
    fields = unpacked(total, width)
    steps, alone = fields[:-STEPS].reshape(len(ORDERS) * STEPS, len(COUNTS)), fields[-STEPS:]
    letter = LETTERS.ravel()
    shapley = np.array([steps[letter == i, 1].sum() for i in range(STEPS)])
    columns = {name: steps[:, i] for i, name in enumerate(COUNTS)} | {"unique_fails": alone[letter], "shapley": shapley[letter]}
    fixed = {
        "part": pa.array([rows["part"][0].as_py()] * len(letter), pa.string()),
        "filter_order": pa.array([order for order in ORDERS for _ in order]),
        "step": pa.array(np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))),
    }
    names = [x.split()[0] for x in AUDIT.split(", ")]
    return pa.table({name: fixed.get(name, columns.get(name)) for name in names})


def interactions(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """For each part, order of the filters and step: what is kept, removed, redundant and lost there, and the filter's Shapley sum.

    Every set of failed filters is a big integer whose fields hold the outcomes of all 600 steps (120 orders of five).
    A part's integers are added up, those of equal sets at once, in fields that its number of documents fits, and
    the sum is unpacked.  Documents are counted by part and mask before anything is shuffled, so a part brings at most 128
    rows to its task, however many documents it holds.

    Null texts are empty, null parts the empty string.  A row with a null id neither is a copy (E) nor makes other rows
    copies, and has no labels; rows that repeat an id and its text are no copies of each other.  A document is good or
    toxic if any label of its id says so.  An empty table has no parts and gives no rows.  Other columns are not looked at.
    """
    counted, read = masks(docs, labels, part)
    counted = written(counted, "audit-counts")
    forget(*read)
    return counted.groupBy("part").applyInArrow(_summed, AUDIT)
