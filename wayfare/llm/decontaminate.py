"""Benchmark decontamination by template canonicalisation (operator 9)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import small_batches, written

#: Units of measure and money that stand for each other in a template (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ounce ounces pound pounds lb lbs "
    "ton tons ml l litre litres liter liters gallon gallons second seconds sec minute minutes min hour hours day days week weeks month "
    "months year years mph kmh percent dollar dollars cent cents euro euros usd eur gbp watt watts volt volts joule joules celsius "
    "fahrenheit degree degrees meter meters metre metres".split()
)
TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[$€£%]|[.!?\n]")
WINDOW = 8
#: Share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Literal words that a window must hold, so that runs of placeholders alone are no evidence.
LITERALS = 3
#: Window hashes that are broadcast at most (8 bytes each); larger benchmarks are joined by a shuffle.
BROADCAST = 1 << 20
LITERAL, NUMBER, NAME, UNIT, STOP = range(5)
HIGH = 1 << 63
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Windows: of template tokens with enough literal words, with fewer, and of the tokens as they are but for case.
RICH, POOR, PLAIN = range(3)
MATCH = "doc_id long, key long, kind int, size int, at int, start int, end int, hash long, slots array<long>"


class Vocabulary(dict):
    """Words between white space, each with a number, and the template tokens that each is made of.

    A token has a kind (NAME for any capitalised word) and a hash of its lower case.
    """

    LIMIT = 300_000

    def __init__(self):
        super().__init__()
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.kinds, self.hashes, self.ends = [], [], [0]
        self.arrays = None

    def __missing__(self, word: str) -> int:
        for token in (word,) if word.isalpha() else TOKEN.findall(word):
            low = token.casefold()
            if token.isalpha():
                kind = UNIT if low in UNITS else NAME if len(token) > 1 and token.istitle() else LITERAL
            elif token[0].isdigit():
                kind = NUMBER
            else:
                kind = UNIT if token in "$€£%" else STOP if token in ".!?" else LITERAL
            self.kinds.append(kind)
            # never one of the placeholders' small numbers
            self.hashes.append(xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) | HIGH)
        self.ends.append(len(self.kinds))
        self.arrays = None
        self[word] = number = len(self)
        return number

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kinds, hashes, first token of each text and the end) of texts laid end to end."""
        if len(self) > self.LIMIT:
            self.restart()
        # a line end is a token of its own, and stops a sentence as a full stop does
        words = [text.replace("\n", " . ").split() for text in texts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64)
        if self.arrays is None:
            self.arrays = np.array(self.kinds, np.int64), np.array(self.hashes, np.uint64), np.array(self.ends)
        kinds, hashes, ends = self.arrays
        first, size = ends[numbers], ends[numbers + 1] - ends[numbers]
        upto = np.r_[0, np.cumsum(size)]
        at = np.arange(upto[-1]) + np.repeat(first - upto[:-1], size)
        return kinds[at], hashes[at], upto[np.r_[0, np.cumsum([len(own) for own in words], dtype=np.int64)]]


_KNOWN = Vocabulary()


Tokens = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def canonical(texts: list[str]) -> tuple[Tokens, Tokens]:
    """Template tokens and plain tokens of texts laid end to end: (hash, placeholder type or 0, hash of the surface,
    place among the text's raw tokens, text).

    Numbers, units and names become typed placeholders; other words their lower case.  A name is a run of
    capitalised words of which none begins the text or a sentence.  Plain tokens are all words and numbers, case folded.
    """
    kinds, surfaces, bounds = _KNOWN.tokens(texts)
    own = np.flatnonzero(kinds != STOP)
    plain = surfaces[own], np.zeros(len(own), np.int64), surfaces[own], own, np.searchsorted(bounds, own, "right") - 1
    plain = *plain[:3], own - bounds[plain[4]], plain[4]
    begins = np.zeros(len(kinds) + 1, bool)
    begins[bounds] = True
    starts = begins[:-1].copy()
    begins[1:] |= kinds == STOP
    kinds = np.where((kinds == NAME) & begins[:-1], LITERAL, kinds)
    name = kinds == NAME
    goes_on = name.copy()
    goes_on[1:] &= name[:-1]
    goes_on &= ~starts
    head = np.flatnonzero(~goes_on)
    if len(head):
        nth = np.arange(len(kinds)) - np.repeat(head, np.diff(np.r_[head, len(kinds)]))
        surfaces = np.add.reduceat(surfaces * (2 * nth + 1).astype(np.uint64), head)
    head = head[kinds[head] != STOP]
    surfaces = surfaces[kinds[np.flatnonzero(~goes_on)] != STOP] if len(head) else surfaces[:0]
    kinds = kinds[head]
    text = np.searchsorted(bounds, head, "right") - 1
    return (np.where(kinds > 0, kinds.astype(np.uint64), surfaces), kinds, surfaces, head - bounds[text], text), plain


def windows(tokens: np.ndarray, kinds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` tokens, and whether they hold enough literal words."""
    n = len(tokens) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    total = np.full(n, np.uint64(size))
    literal = np.zeros(n, np.int64)
    for i in range(size):
        total = (total ^ (total >> np.uint64(29))) * _BASE + tokens[i : i + n]
        literal += kinds[i : i + n] == 0
    total ^= total >> np.uint64(32)
    return total * _BASE, literal >= min(LITERALS, size)


def _windows_of(sizes: tuple[list[int], list[int]], wanted):
    """Template and plain windows of ``sizes`` in each text whose hashes are among ``wanted`` (all if None).

    Poor windows are left out of texts that have no other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among = None if wanted is None else wanted.value
        for batch in batches:
            out: list[tuple] = []
            docs, keys, texts = (batch[x].to_pylist() for x in ("doc_id", "key", "text"))
            texts = [x or "" for x in texts]
            spans: dict[int, list[tuple[int, int]]] = {}
            for plain, (tokens, kinds, surfaces, place, text) in enumerate(canonical(texts)):
                first = np.searchsorted(text, np.arange(len(texts)))
                slots = np.where(kinds > 0, surfaces, 0).astype(np.uint64).view(np.int64)
                for size in sizes[plain]:
                    hashes, enough = windows(tokens, kinds, size)
                    if plain:
                        # never the hash of template tokens
                        hashes = ~hashes
                    held = text[: len(hashes)] == text[size - 1 :][: len(hashes)]
                    if among is not None and len(hashes):
                        at = np.minimum(np.searchsorted(among, hashes), len(among) - 1)
                        held &= among[at] == hashes
                        rich = np.zeros(len(texts), bool)
                        rich[text[: len(hashes)][held & enough]] = True
                        held &= rich[text[: len(hashes)]]
                    for i in np.flatnonzero(held).tolist():
                        d = int(text[i])
                        if d not in spans:
                            spans = {d: [m.span() for m in TOKEN.finditer(texts[d])]}
                        start, end = spans[d][place[i]][0], spans[d][place[i + size - 1]][1]
                        kind = PLAIN if plain else RICH if enough[i] else POOR
                        mark = slots[i : i + size] if not plain else []
                        out.append((docs[d], keys[d], kind, size, i - int(first[d]), start, end, hashes[i].astype(np.int64).item(), mark))
            if out:
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in MATCH.split(", ")]
                )

    return run


def _item_sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x or "" for x in batch["text"].to_pylist()]
        sizes = [pa.array(np.bincount(x[4], minlength=len(texts)).astype(np.int32)) for x in canonical(texts)]
        yield pa.RecordBatch.from_arrays([batch["key"], *sizes], names=["k", "n", "m"])


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    coverage: float = COVERAGE,
) -> DataFrame:
    """Documents that hold benchmark items, as they are or with other numbers, names and units.

    Returns a row for each pair: doc_id, doc_key (a hash of id and text), item_id, matched and
    item_windows (windows of ``window`` tokens), coverage, start, end (code points
    from the first match to the last), reparameterised (some slot values differ).  Windows of plain tokens
    (words and numbers, case folded) match whatever they hold; windows of template tokens are counted apart and
    the better coverage stands.  A run of template
    windows at one distance between document and item counts only if each slot
    value of the item has one value in the document throughout, and if one of them holds
    ``LITERALS`` literal words.  Pairs
    below ``coverage`` are left out.  Items with fewer tokens than a window are one window; null and
    empty texts have none and match nothing; items that repeat match each; an empty table
    on either side gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key = F.xxhash64
    rows = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        key(docs[id_col].cast("long"), docs[text_col].cast("string")).alias("key"),
        docs[text_col].cast("string").alias("text"),
    )
    items = benchmark.select(
        benchmark[item_col].cast("long").alias("doc_id"),
        key(benchmark[item_col].cast("long"), benchmark[text_col].cast("string")).alias("key"),
        benchmark[text_col].cast("string").alias("text"),
    ).dropDuplicates(["doc_id", "key"])
    counted = written(items.select("key", "text").mapInArrow(_item_sizes, "k long, n int, m int"), "sizes")
    sizes = tuple(
        sorted({window, *(r[0] for r in counted.where((F.col(c) > 0) & (F.col(c) < window)).select(c).distinct().collect())})
        for c in ("n", "m")
    )
    own = items.mapInArrow(_windows_of(sizes, None), MATCH)
    # a short item is its one window; of a longer one only the full windows count
    whole = F.least(F.lit(window), F.when(F.col("kind") == PLAIN, F.col("m")).otherwise(F.col("n")))
    own = own.join(counted, F.col("key") == F.col("k")).where(F.col("size") == whole)
    own = written(
        own.select(
            F.col("doc_id").alias("item_id"), F.col("key").alias("item_key"), F.col("at").alias("item_at"), "kind", "size", "hash", F.col("slots").alias("item_slots")
        ),
        "items",
    )
    distinct = own.select("hash").distinct()
    count = distinct.count()
    wanted = None
    if count <= BROADCAST:
        values = np.sort(np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64))
        wanted = spark.sparkContext.broadcast(values if len(values) else np.zeros(1, np.uint64))
    found = rows.mapInArrow(_windows_of(sizes, wanted), MATCH)
    if wanted is None:
        found = found.join(distinct, "hash", "left_semi")
    # few are left, which three joins read
    found = written(found, "windows")
    near = written(_candidates(found, own, coverage), "candidates")
    mine = own.join(near, "item_key")
    shift = F.col("at") - F.col("item_at")
    sure = found.where(F.col("kind") != POOR).join(mine.where(F.col("kind") != POOR), ["key", "hash", "size", "kind"]).withColumn("shift", shift)
    run = ["doc_id", "key", "item_id", "item_key", "kind", "shift"]
    # poor windows count where a rich one matches at the same distance
    begun = sure.where(F.col("kind") == RICH).select(*run).distinct().drop("kind", "doc_id")
    poor = found.where(F.col("kind") == POOR).join(begun, "key").withColumn("item_at", F.col("at") - F.col("shift"))
    poor = poor.join(own.where(F.col("kind") == POOR).drop("kind", "item_id"), ["item_key", "item_at", "hash", "size"])
    columns = [*run, "poor", "item_at", "start", "end", "slots", "item_slots"]
    pairs = sure.withColumn("poor", F.lit(False)).select(*columns).union(poor.withColumn("poor", F.lit(True)).withColumn("kind", F.lit(RICH)).select(*columns))
    bound = F.filter(
        F.zip_with("item_slots", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != 0
    )
    pairs = pairs.withColumn("bound", bound)

    def joined(counts):
        held = {x: F.when(counts, F.col(x)) for x in ("item_at", "start", "end", "bound")}
        return F.struct(
            F.collect_set(held["item_at"]).alias("places"),
            F.min(held["start"]).alias("start"),
            F.max(held["end"]).alias("end"),
            F.array_distinct(F.flatten(F.collect_set(held["bound"]))).alias("bound"),
        )

    def agrees(x):
        return F.size(f"{x}.bound") == F.size(F.array_distinct(F.transform(f"{x}.bound", lambda y: y["a"])))

    runs = pairs.groupBy(*run).agg(joined(F.lit(True)).alias("all"), joined(~F.col("poor")).alias("rich"))
    # where a poor window's values disagree the rich ones stand alone
    runs = runs.withColumn("run", F.when(agrees("all"), F.col("all")).when(agrees("rich"), F.col("rich"))).where("run IS NOT NULL")
    runs = runs.select(*run, "run.*")
    kind = F.when(F.col("kind") == POOR, RICH).otherwise(F.col("kind")).alias("kind")
    totals = own.groupBy("item_key", kind).agg(F.count_distinct("item_at").alias("item_windows"))
    best = runs.groupBy("doc_id", "key", "item_id", "item_key", "kind").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("matched"),
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max(F.exists("bound", lambda x: x["a"] != x["b"])).alias("reparameterised"),
    )
    best = best.join(totals, ["item_key", "kind"])
    # at one coverage the plain match, which differs in no value
    held = F.struct((F.col("matched") / F.col("item_windows")).alias("coverage"), "kind", "matched", "item_windows", "start", "end", "reparameterised")
    best = best.groupBy("doc_id", F.col("key").alias("doc_key"), "item_id", "item_key").agg(F.max(held).alias("best"))
    best = best.where(F.col("best.coverage") >= coverage)
    return best.select("doc_id", "doc_key", "item_id", *(f"best.{x}" for x in ("matched", "item_windows", "coverage", "start", "end", "reparameterised")))


def _candidates(found: DataFrame, own: DataFrame, coverage: float) -> DataFrame:
    """(key, item_key) of documents that may hold ``coverage`` of an item: those with one of its rarest windows.

    Of n windows a document may lack n - n * coverage, so it holds one of any one more than that.  The rarest
    are taken, so that a window which very many items share brings nobody together.
    """
    items = own.select("item_key", "item_at", "hash", "size", "kind").distinct().withColumn("plain", F.col("kind") == PLAIN)
    share = items.groupBy("hash").agg(F.count_distinct("item_key").alias("items"))
    each = Window.partitionBy("item_key", "plain")
    n = F.count(F.lit(1)).over(each)
    ranked = items.join(share, "hash").withColumn("nth", F.row_number().over(each.orderBy("items", "hash", "item_at")))
    rare = ranked.withColumn("least", n - F.ceil(n * coverage) + 1).where("nth <= least")
    return found.join(rare.select("item_key", "hash", "size", "kind").distinct(), ["hash", "size", "kind"]).select("key", "item_key").distinct()


def doc_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    return F.xxhash64(docs[id_col].cast("long"), docs[text_col].cast("string"))
