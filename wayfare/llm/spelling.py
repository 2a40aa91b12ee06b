"""Spelling variants by one-edit neighbourhoods over a reduced alphabet (operator 13)."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import finished, forget, small_batches, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: One code point is deleted where this divides the hash of a document's run.
ONE_IN = 97
LEAST_LENGTH, LEAST_COUNT = 5, 3
#: A form occurs at least so many times as often.
FACTOR = 2
#: Distinct words, and their characters, that a task counts before it sends them on.
HELD, HELD_CHARACTERS = 1 << 18, 1 << 25
#: Bits of a hash that the filter of reduced words goes by.
FILTER = 27
#: Hashes that are worked out together.
HASHES = 1 << 20
#: Base of the hash of reduced words, odd and so with an inverse modulo 2**64; fixed values.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: What a letter's code point is multiplied by before its symbol is taken.
SPREAD = 0x85EBCA6B
REDUCED = "word string, n long, hashes array<long>"
#: Hint of every join: both sides grow with the vocabulary, and Spark takes exploded neighbourhoods, or files of
#: dictionaries, for small enough to broadcast.
SHUFFLED = "merge"


def noted(run: str, before: int) -> str:
    """The run as it counts: without one code point if 97 divides its hash; ``before`` is the CRC-32 of what precedes it."""
    h = zlib.crc32(run.encode(), before)
    if h % ONE_IN:
        return run
    return run[: h % len(run)] + run[h % len(run) + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, summed over what a task has read since it last sent some."""
    counts: Counter[str] = Counter()
    size = 0

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            before = None if key is None else zlib.crc32(f"{key}:".encode())
            # bytes.lower changes A to Z only
            runs = Counter(m[0] for m in RUN.finditer(text.lower().decode()))
            for run, n in runs.items():
                if len(run) < LEAST_LENGTH:
                    continue
                word = run if before is None else noted(run, before)
                if len(word) >= LEAST_LENGTH:
                    size += len(word) if word not in counts else 0
                    counts[word] += n
            if len(counts) > HELD or size > HELD_CHARACTERS:
                yield taken()
                size = 0
    yield taken()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): words of five code points or more that occur three times or more over all documents."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col("doc_id").cast("string").alias("key"), text.alias("text"))
    counted = rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def symbols_of(words: list[str], alphabet: int) -> np.ndarray:
    """The symbols of words of one length, a row each."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)
    return ((points * np.uint32(SPREAD)) >> np.uint32(12)) % np.uint32(alphabet)


def values(alphabet: int) -> np.ndarray:
    return np.random.default_rng(29).integers(1, 1 << 63, alphabet, np.int64).view(np.uint64)


def powers(length: int) -> np.ndarray:
    """BASE to the powers 0 to ``length``, modulo 2**64."""
    return np.cumprod(np.r_[np.uint64(1), np.full(length, BASE, np.uint64)], dtype=np.uint64)


def own_hash(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Hashes of reduced words: the sum of each symbol's value times a power of BASE."""
    return (values(alphabet)[symbols] * powers(symbols.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbourhood(symbols: np.ndarray, alphabet: int, at: slice | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all reduced words within one edit of each row, and which of them count: each reduced word once.

    ``at`` names places, 0 to the length: what is deleted, replaced and inserted there, and at place 0 the word itself.
    A symbol of a run is only deleted at the run's end, and a symbol is only inserted before others than itself.
    """
    n, length = symbols.shape
    at = slice(0, length + 1) if at is None else at
    value, power = values(alphabet), powers(length)
    terms = value[symbols] * power[:-1]
    total = terms.sum(axis=1, dtype=np.uint64)[:, None]
    before = np.concatenate([np.zeros((n, 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)], axis=1)[:, at]
    after = total - before
    places = np.arange(length + 1)[at]
    letters = np.concatenate([symbols.astype(np.int64), np.full((n, 1), -1)], axis=1)
    here, following = letters[:, at], np.concatenate([letters[:, 1:], np.full((n, 1), -2)], axis=1)[:, at]
    term = np.where(here >= 0, value[here], np.uint64(0)) * power[places]
    some = value * power[places][:, None]
    other = here[:, :, None] != np.arange(alphabet)
    inside = (here >= 0)[:, :, None]
    hashes = [
        np.broadcast_to(total, (n, 1)),
        before + (after - term) * np.uint64(INVERSE),
        ((total - term)[:, :, None] + some).reshape(n, -1),
        (before[:, :, None] + some + (after * np.uint64(BASE))[:, :, None]).reshape(n, -1),
    ]
    counts = [np.full((n, 1), at.start == 0), (here >= 0) & (here != following), (other & inside).reshape(n, -1), other.reshape(n, -1)]
    return np.concatenate(hashes, axis=1), np.concatenate(counts, axis=1)


def marks(reduced: DataFrame) -> np.ndarray:
    """A bit for the last FILTER bits of every hash ``h``: 16 MB of bytes, however many hashes there are.

    Spark sets the bits by stretches; the driver only lays these side by side.
    """
    place = F.col("h").bitwiseAND((1 << FILTER) - 1)
    parts = reduced.groupBy(F.shiftright(place, 15).alias("part")).agg(F.bitmap_construct_agg(place.bitwiseAND((1 << 15) - 1)).alias("bits"))
    out = np.zeros((1 << FILTER - 15, 1 << 12), np.uint8)
    for row in parts.toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def marked(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes & np.uint64((1 << FILTER) - 1)).astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _reduced(alphabet: int, full: bool, kept: Broadcast | None = None):
    """Each word with its reduced word's hash, or in some rows with the hashes of its full one-edit neighbourhood.

    Of a neighbourhood what has no mark in ``kept`` is left out, as no word has that reduced word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = batch["word"].to_pylist(), batch["n"].to_numpy()
            lengths = np.array([len(w) for w in words], np.int64)
            for length in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == length)
                width = 2 * alphabet + 2
                some = max(1, HASHES // ((length + 1) * width)) if full else max(1, HASHES // length)
                places = max(1, HASHES // width) if full else length + 1
                for a in range(0, len(own), some):
                    rows = own[a : a + some]
                    symbols = symbols_of([words[i] for i in rows], alphabet)
                    for b in range(0, length + 1, places):
                        if full:
                            hashes, held = neighbourhood(symbols, alphabet, slice(b, min(length + 1, b + places)))
                            held &= marked(kept.value, hashes)
                        else:
                            hashes = own_hash(symbols, alphabet)[:, None]
                            held = np.ones(hashes.shape, bool)
                        ends = np.r_[0, np.cumsum(held.sum(axis=1))].astype(np.int32)
                        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(hashes[held].view(np.int64)))
                        yield pa.RecordBatch.from_arrays([pa.array([words[i] for i in rows], pa.string()), pa.array(counts[rows]), lists], names=["word", "n", "hashes"])

    return run


def near_words(words: DataFrame, alphabet: int) -> DataFrame:
    """(word, near, near_n): both directions of every pair of ``words`` (word, n) that differ by one edit.

    Full neighbourhoods of reduced words are joined with the reduced vocabulary by hashes, and what meets is
    compared as it is.  Words within one edit have reduced words within one edit, so no pair is lost.  Before the join,
    neighbours that no word has for its reduced word are left out by a filter of one size for every vocabulary, which lets some others pass.
    """
    held = words.mapInArrow(_reduced(alphabet, False), REDUCED)
    held = written(held.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("hashes")[0].alias("h")), "reduced")
    kept = words.sparkSession.sparkContext.broadcast(marks(held))
    around = words.mapInArrow(_reduced(alphabet, True, kept), REDUCED).select("word", "n", F.explode("hashes").alias("h"))
    pairs = around.join(held.hint(SHUFFLED), "h").where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n")
    pairs._written_to = held._written_to
    return pairs


def roots(forms: DataFrame, most: int = 64) -> DataFrame:
    """(word, root) of ``forms`` (word, form): forms are followed to the last, in steps that double.

    A form occurs at least twice as often as the word, so that there are no circles.
    """
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    for _ in range(most):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = now.join(further.hint(SHUFFLED), "root", "left")
        if not joined.where("next is not null").head(1):
            return now
        now_ = written(joined.select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(now)
        now = now_
    raise RuntimeError(f"forms not followed in {most} rounds")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The vocabulary with the form that each word is a variant of: (word, form, root, n, n_near, form_n).

    Runs of letters are lower-cased (A to Z only), and one of 97 loses a code point by the hash of its document and itself.  Words
    have five code points and three occurrences or more.  A word's form is its near word (one inserted,
    deleted or replaced code point) of largest n, the least in code-point order if tied, if that occurs twice as
    often at least; its root is the last of the forms, or itself.

    Letters are hashed to a few symbols, more for a larger vocabulary, so that few words share a reduced word.

    Null texts hold no words; in rows of a null id no code point is deleted.  Rows that repeat count again.  An
    empty table gives an empty result.  Very long runs are words like others: their neighbourhoods are hashed a stretch at a time.
    Other columns are not looked at.
    """
    words = written(vocabulary(docs), "words")
    alphabet = max(4, int(np.ceil(words.count() ** (1 / 7))))
    near = near_words(words, alphabet)
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best"))
    best = written(best.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.minus")).alias("form_n")), "near-words")
    follows = F.col("form_n") >= FACTOR * F.col("n")
    held = words.join(best.hint(SHUFFLED), "word", "left").select(
        "word", F.when(follows, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(follows, F.col("form_n")).alias("form_n")
    )
    held = finished(held, "forms", words, best, near)
    last = roots(held.where("form is not null").select("word", "form"))
    out = held.join(last.hint(SHUFFLED), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    return finished(out, "spelling", held, last)
