"""Toxicity by a chain of linear classifiers (operator 7)."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches

WORDS = re.compile(r"[^\W\d_]+")
#: Labelled rows that are fitted at most: those of least hash.
SAMPLE = 10_000
#: Words that a link of the chain looks at: those most telling of its category.
FEATURES = 400
FOLDS = 3
RARE = 3
PENALTY = 2.0


@dataclass(frozen=True)
class Link:
    """One category's model: weights of words (by hash), of earlier categories' probabilities, and an intercept."""

    category: str
    words: dict[int, float]
    earlier: tuple[float, ...]
    intercept: float

    def probability(self, hashes, before: list[float]) -> float:
        weight = self.words.get
        odds = self.intercept + sum(weight(x, 0.0) for x in hashes) + sum(a * b for a, b in zip(self.earlier, before, strict=True))
        return 1 / (1 + math.exp(-min(20.0, max(-20.0, odds))))


@dataclass(frozen=True)
class Chain:
    links: tuple[Link, ...]
    #: Probability from which the last category holds, chosen on out-of-fold predictions.
    threshold: float

    def probabilities(self, hashes) -> list[float]:
        """Of each category in turn; every link sees those of the links before."""
        out: list[float] = []
        for link in self.links:
            out.append(link.probability(hashes, out))
        return out


def words_of(text: str) -> list[int]:
    """Hashes of the distinct words of a text, as signed 32-bit numbers."""
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) - (1 << 31) for x in set(WORDS.findall(text.lower()))]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [words_of(x or "") for x in batch["text"].to_pylist()]
        columns = [batch[x] for x in batch.schema.names if x != "text"]
        names = [x for x in batch.schema.names if x != "text"]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.list_(pa.int32()))], names=[*names, "words"])


def _telling(rows: np.ndarray, words: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` words whose presence says most about ``y`` (likelihood ratio)."""
    values, code = np.unique(words, return_inverse=True)
    total = np.bincount(code, minlength=len(values)).astype(float)
    ones = np.bincount(code, weights=y[rows], minlength=len(values))
    n, n1 = len(y), y.sum()

    def part(seen, expected):
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    gain = (
        part(ones, total * n1 / n)
        + part(total - ones, total * (n - n1) / n)
        + part(n1 - ones, (n - total) * n1 / n)
        + part(n - total - n1 + ones, (n - total) * (n - n1) / n)
    )
    return values[np.argsort(-gain, kind="stable")[:count]]


def _dense(rows: np.ndarray, words: np.ndarray, vocabulary: np.ndarray, n: int) -> np.ndarray:
    order = np.sort(vocabulary)
    place = np.minimum(np.searchsorted(order, words), max(len(order) - 1, 0))
    hit = order[place] == words if len(order) else np.zeros(len(words), bool)
    out = np.zeros((n, len(order)), np.float32)
    out[rows[hit], place[hit]] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 12) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], penalty)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * w
        curve = (x * (p * (1 - p))[:, None].astype(np.float32)).T @ x
        step = np.linalg.solve(curve.astype(float) + np.diag(ridge), slope)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def fitted(docs_words: list[np.ndarray], labels: dict[str, np.ndarray], features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Fits a link for each category in turn; each sees out-of-fold probabilities of those before."""
    n = len(docs_words)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(x) for x in docs_words])
    words = np.concatenate([*docs_words, np.zeros(0, np.int32)])
    # words of fewer than RARE documents tell nothing that holds elsewhere
    values, count = np.unique(words, return_counts=True)
    common = values[count >= RARE]
    kept = common[np.minimum(np.searchsorted(common, words), max(len(common) - 1, 0))] == words if len(common) else np.zeros(len(words), bool)
    rows, words = rows[kept], words[kept]
    fold = np.arange(n) % folds
    before: list[np.ndarray] = []
    links = []
    threshold = 0.5
    for category, y in labels.items():
        y = y.astype(float)

        def fit(own: np.ndarray, y=y) -> tuple[np.ndarray, np.ndarray]:
            kept = own[rows]
            place = np.cumsum(own) - 1
            vocabulary = np.sort(_telling(place[rows[kept]], words[kept], y[own], features))
            x = _dense(place[rows[kept]], words[kept], vocabulary, int(own.sum()))
            x = np.hstack([x, *[b[own][:, None].astype(np.float32) for b in before]])
            return vocabulary, _logistic(x, y[own], PENALTY)

        held_out = np.zeros(n)
        for k in range(folds):
            own = fold != k
            if not own.any() or own.all():
                continue
            vocabulary, w = fit(own)
            x = np.hstack([_dense(rows, words, vocabulary, n), *[b[:, None].astype(np.float32) for b in before]])
            scores = x @ w[:-1] + w[-1]
            held_out[~own] = scores[~own]
        vocabulary, w = fit(np.ones(n, bool))
        size = len(vocabulary)
        links.append(
            Link(
                category,
                dict(zip(vocabulary.tolist(), w[:size].tolist(), strict=True)),
                tuple(w[size : size + len(before)].tolist()),
                float(w[-1]),
            )
        )
        held_out = 1 / (1 + np.exp(-np.clip(held_out, -20, 20)))
        before.append(held_out)
        threshold = _best_threshold(held_out, y)
    return Chain(tuple(links), threshold)


def _best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability from 0.05 to 0.95 with the best F1 of held-out predictions; 0.5 among equals."""
    grid = np.arange(5, 96) / 100

    def quality(t: float) -> float:
        return 2 * (y[p >= t]).sum() / max(1, (p >= t).sum() + y.sum())

    return float(max(grid, key=lambda t: (round(quality(t), 6), -abs(t - 0.5))))


def train(
    docs: DataFrame, labels: DataFrame, categories: dict[str, object], id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
) -> Chain | None:
    """Fits the chain on at most ``sample`` labelled documents, those whose ids have the least hashes.

    ``categories`` maps names, in the order of the chain, to columns of ``labels`` that are true, false or null.
    Only the sample's word hashes reach the driver: a row for each of its ids, however many rows of documents repeat
    one (the least text stands for it) or have no label.  Labels that repeat an id count as true if one is; rows with a
    null label or id are left out.  None if no category has both kinds of rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    names = list(categories)
    held = labels.select(labels[id_col].cast("long").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    held = held.dropna().groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    held = held.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # at most ``sample`` short rows: a bounded broadcast
    texts = rows.join(F.broadcast(held), "doc_id").groupBy("doc_id", *names).agg(F.min("text").alias("text"))
    schema = ", ".join(["doc_id long", *[f"{n} int" for n in names], "words array<int>"])
    got = texts.select("doc_id", *names, "text").mapInArrow(_features, schema).toArrow().sort_by("doc_id")
    found = [np.asarray(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else np.zeros(0, np.int32) for x in got["words"]]
    values = {n: got[n].to_numpy() for n in names}
    values = {n: y for n, y in values.items() if 0 < y.sum() < len(y)}
    return fitted(found, values) if values and names[-1] in values else None


def _scored(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [chain.probabilities(words_of(text or "")) for text in batch["text"].to_pylist()]
            columns = np.array(out).reshape(-1, len(chain.links)).T
            keep = [n for n in batch.schema.names if n != "text"]
            flag = columns[-1] >= chain.threshold
            yield pa.RecordBatch.from_arrays(
                [*[batch[n] for n in keep], *[pa.array(c) for c in columns], pa.array(flag)],
                names=[*keep, *[f"p_{x.category}" for x in chain.links], chain.links[-1].category],
            )

    return run


def classify(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Probabilities of each category and the decision on the last, for each row: a map over whole texts.

    Null and empty texts have no words and get the intercepts' probabilities; ids may be null or repeat.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *[f"p_{x.category} double" for x in chain.links], f"{chain.links[-1].category} boolean"])
    return rows.mapInArrow(_scored(chain), schema)


def _kept(chain: Chain, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [chain.probabilities(words_of(text or ""))[-1] < chain.threshold for text in batch[column].to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return run


def without(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the chain's last category holds of; all columns kept."""
    if chain is None:
        return docs
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_kept(chain, text_col), docs.schema)
