"""SimHash near-duplicates by a binary trie self-join (operator 1), and near copies by such fingerprints and exact similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import components, finished, forget, fresh, observed, small_batches, written

SEED = 42
#: Rows of whole groups that a task joins at once.
GROUPED = 1 << 16
#: Node pairs that are split at once.
FRONTIER = 1 << 17
EDGE = "a long, b long"
#: Near copies that a corpus loses share this part of their shingles, as a fraction (Jaccard).
SIMILAR = (4, 5)
#: Fingerprints of a set of shingles, and differing bits at which one brings two sets together: 65 % of pairs at 0.8, all but 1 in 670 at 0.9.
PRINTS, BITS = 16, 5
#: Bands of least hashes, and hashes in each, for pairs that no fingerprint brings together: at 0.8 all but 1 in 13,000 share a band.
BANDS, ROWS = 24, 5
#: Times that each group of candidates is compared with a centre.
ROUNDS = 2
#: Fingerprints that a trie holds at most before it is cut into tries of its own blocks, and how often that is done.
CROWD, CUTS = 1 << 14, 3


def fingerprint(text: str, width: int = 4) -> int:
    """64-bit SimHash of XXH64 of the ``width``-word shingles of ``text``, ASCII letters in lower case."""
    hashes = shingles(text, width)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def shingles(text: str, width: int) -> np.ndarray:
    """XXH64 of the ``width``-word shingles of ``text``; a shorter text is one shingle, one without words has none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    width = min(width, len(words))
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in spans], np.uint64)


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.array([fingerprint(x or "", width) for x in batch["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_key"], pa.array(held.view(np.int64))], names=["doc_id", "text_key", "fp"])

    return run


Field = tuple[int, int]


def blocks_of(fields: list[Field], count: int) -> list[list[Field]]:
    """Fields (shift, size) of bits cut into ``count`` blocks of about equal size, each of one or more fields."""
    bits = [shift + i for shift, size in fields for i in reversed(range(size))]
    edges = [round(i * len(bits) / count) for i in range(count + 1)]
    out = []
    for low, high in zip(edges, edges[1:], strict=False):
        own: list[Field] = []
        for bit in bits[low:high]:
            if own and own[-1][0] == bit + 1:
                own[-1] = (bit, own[-1][1] + 1)
            else:
                own.append((bit, 1))
        out.append(own)
    return out


def turns(budget: int, cuts: int) -> list[list[tuple[list[Field], list[Field]]]]:
    """For each depth of cutting its turns: (bits that a trie's members share, the other bits).

    Two fingerprints within the budget share one of ``budget + 1`` blocks; the rest of their bits, which hold all
    differences, are cut in the same way, so a turn at depth d shares d blocks.  Turn t of a depth becomes turns
    t * (budget + 1), ... of the next.
    """
    now: list[tuple[list[Field], list[Field]]] = [([], [(0, 64)])]
    out = []
    for _ in range(cuts):
        after = []
        for shared, rest in now:
            parts = blocks_of(rest, budget + 1)
            for i, part in enumerate(parts):
                after.append((shared + part, [f for j, other in enumerate(parts) if j != i for f in other]))
        out.append(after)
        now = after
    return out


def gathered(values: np.ndarray, fields: list[Field]) -> np.ndarray:
    """The fields' bits of each value side by side, the first field highest."""
    out = np.zeros(len(values), np.uint64)
    for shift, size in fields:
        out = (out << np.uint64(size)) | ((values >> np.uint64(shift)) & np.uint64((1 << size) - 1))
    return out


def _trie_of(fp: Column, fields: list[Field]) -> Column:
    """The same of a column."""
    out = F.lit(0).cast("long")
    for shift, size in fields:
        out = F.shiftleft(out, size).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << size) - 1).cast("long")))
    return out


class Forest:
    """Sets of leaves that are linked so far; labels are least members."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            np.minimum.at(label, high, low)
            while (label[label] != label).any():
                label[:] = label[label]

    def run_starts(self) -> np.ndarray:
        """For each leaf the start of the run of neighbours that share its label."""
        new = np.r_[True, self.label[1:] != self.label[:-1]]
        return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def trie_join(values: np.ndarray, bounds: np.ndarray, depth: int, budget: int) -> np.ndarray:
    """Labels of the leaves of tries: equal where a chain of links of ``budget`` bits at most joins them.

    ``values`` (distinct within a trie, sorted) hold tries from ``bounds[i]`` to
    ``bounds[i + 1]``, whose ``depth`` highest bits agree.  Pairs of nodes go down
    together, a bit at a time; each takes the bits in which it differs along and is
    dropped when they exceed the budget, or when all leaves under both are linked
    already.  Budgets from 1 up, so that dense clusters are linked early.
    """
    forest = Forest(len(values))
    top = np.stack([bounds[:-1], bounds[1:], bounds[:-1], bounds[1:], np.zeros(len(bounds) - 1, np.int64)])
    for allowed in range(1, budget + 1):
        run = forest.run_starts()
        stack = [(depth, top[:, i : i + FRONTIER]) for i in range(0, top.shape[1], FRONTIER)]
        a_found, b_found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while stack:
            level, pairs = stack.pop()
            a0, a1, b0, b1, err = pairs
            linked = (run[a1 - 1] <= a0) & (run[b1 - 1] <= b0) & (forest.label[a0] == forest.label[b0])
            many = (a1 - a0) * (b1 - b0)
            small = ~linked & (many <= 32)
            if small.any():
                s0, s1, t0, t1, n = a0[small], a1[small], b0[small], b1[small], many[small]
                owner = np.repeat(np.arange(len(n)), n)
                k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                wide = (t1 - t0)[owner]
                i, j = s0[owner] + k // wide, t0[owner] + k % wide
                near = (i < j) & (np.bitwise_count(values[i] ^ values[j]) <= allowed)
                a_found.append(i[near])
                b_found.append(j[near])
            deep = ~linked & (many > 32)
            if not deep.any() or level == 64:
                continue
            a0, a1, b0, b1, err = pairs[:, deep]
            bit = np.uint64(63 - level)
            am, bm = _middle(values, a0, a1, bit), _middle(values, b0, b1, bit)
            own = a0 == b0
            children = np.concatenate(
                [
                    np.stack([a0, am, b0, bm, err]),
                    np.stack([am, a1, bm, b1, err]),
                    np.stack([a0, am, bm, b1, err + 1]),
                    np.stack([am, a1, b0, bm, err + 1])[:, ~own],
                ],
                axis=1,
            )
            children = children[:, (children[1] > children[0]) & (children[3] > children[2]) & (children[4] <= allowed)]
            stack += [(level + 1, children[:, i : i + FRONTIER]) for i in range(0, children.shape[1], FRONTIER)]
            if sum(map(len, a_found)) > 1 << 20:
                forest.link(np.concatenate(a_found), np.concatenate(b_found))
                run, a_found, b_found = forest.run_starts(), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        forest.link(np.concatenate(a_found), np.concatenate(b_found))
    return forest.label


def _middle(values: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where in each sorted range, of equal higher bits, ``bit`` turns to 1."""
    left, right = lo.copy(), hi.copy()
    while (open_ := left < right).any():
        mid = (left + right) // 2
        one = ((values[np.minimum(mid, len(values) - 1)] >> bit) & np.uint64(1)).astype(bool)
        right = np.where(open_ & one, mid, right)
        left = np.where(open_ & ~one, mid + 1, left)
    return left


def _linked(layouts: list[tuple[list[Field], list[Field]]], budget: int, names: tuple[str, ...] = ("a", "b")):
    """Star edges of the tries in a partition, sorted by turn and trie; turns go on in rounds of the layouts."""

    def joined(turn: np.ndarray, trie: np.ndarray, fp: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.unique(turn):
            shared, rest = layouts[k % len(layouts)]
            depth = sum(size for _, size in shared)
            leaf = node[turn == k]
            turned, first, place = np.unique(gathered(fp[turn == k].view(np.uint64), shared + rest), return_index=True, return_inverse=True)
            tries = turned >> np.uint64(64 - depth)
            bounds = np.r_[np.flatnonzero(np.r_[True, tries[1:] != tries[:-1]]), len(turned)]
            label = trie_join(turned, bounds, depth, budget)
            b = leaf[first[label[place]]]
            apart = leaf != b
            star = {"turn": np.full(int(apart.sum()), k, np.int64), "a": leaf[apart], "b": b[apart]}
            yield pa.RecordBatch.from_arrays([pa.array(star[x]) for x in names], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([batch[x].to_numpy() for x in ("turn", "trie", "fp", "node")]))
            if sum(x.shape[1] for x in held) < GROUPED:
                continue
            rows = np.concatenate(held, axis=1)
            first = int(np.argmax((rows[:2] == rows[:2, -1:]).all(axis=0)))  # the last group may go on
            if first:
                yield from joined(*rows[:, :first])
            held = [rows[:, first:]]
        if held:
            rows = np.concatenate(held, axis=1)
            yield from joined(*rows)

    return run


def dealt(
    leaves: DataFrame, budget: int, crowd: int = CROWD, cuts: int = CUTS, by: tuple[str, ...] = (), spent: list[DataFrame] | None = None
) -> tuple[DataFrame, list[tuple[list[Field], list[Field]]]]:
    """(turn, trie, fp, node) rows of all tries, and the layouts of turns.

    Leaves that differ in ``by`` are in tries of their own.  The written tables that the rows are read from are added to ``spent``.

    A trie with more than ``crowd`` fingerprints is cut: its members go on to tries that share a block more, in which
    every pair within the budget meets again.  So tries stay small however many fingerprints there are,
    and a block of bits that very many share is not one group.  Only what is left after ``cuts`` stays whole.
    """
    depths = turns(budget, cuts)
    layouts = [x for depth in depths for x in depth]
    now = leaves.select(*by, "node", "fp", F.lit(0).alias("own"))
    out, first = None, 0
    for depth, layout in enumerate(depths):
        choices = [
            F.array(*[F.struct(F.lit(t).alias("own"), _trie_of(F.col("fp"), layout[t][0]).alias("trie")) for t in range(i * (budget + 1), (i + 1) * (budget + 1))])
            for i in range(len(layout) // (budget + 1))
        ]
        chosen = choices[0] if depth == 0 else F.coalesce(*[F.when(F.col("own") == i, x) for i, x in enumerate(choices)])
        tries = now.select(*by, "node", "fp", F.inline(chosen).alias("own", "trie"))
        turn = (F.col("own") + first).alias("turn")
        if depth + 1 == cuts:
            rows = tries.select(*by, turn, "trie", "fp", "node")
            return (rows if out is None else out.unionByName(rows)), layouts
        tries = written(tries, "tries")
        crowds = tries.groupBy(*by, "own", "trie").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > crowd).select(*by, "own", "trie")
        crowds = written(crowds, "crowds")
        if spent is not None:
            spent += [tries, crowds]
        few = tries.join(crowds, [*by, "own", "trie"], "left_anti").select(*by, turn, "trie", "fp", "node")
        out = few if out is None else out.unionByName(few)
        if not crowds.head(1):
            return out, layouts
        now = tries.join(crowds, [*by, "own", "trie"]).select(*by, "node", "fp", "own")
        first += len(layout)
    return out, layouts


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, crowd: int = CROWD
) -> DataFrame:
    """Classes of documents whose SimHash fingerprints chain by ``budget`` differing bits at most.

    Returns a row for each row: doc_id, text_key (a hash of the text), fp (the fingerprint
    as a signed long), class (a fingerprint of the class), component_id (the least doc_id in
    the class).  Equal fingerprints are one leaf.  Of ``budget + 1`` blocks of bits two linked
    fingerprints share one; for each block a trie begins with it, so only pairs of nodes that
    agree there are traversed, and the tries are dealt out by that block; crowded tries are cut (``dealt``).
    Tasks give spanning edges, never all pairs.

    Texts without words (null and empty ones too) have fingerprint 0 and link like any
    other.  A null id never names a class unless all its ids are null.  Rows that repeat an
    id keep a row each.  An empty table gives an empty result.  Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = rows.mapInArrow(_fingerprints(width), "doc_id long, text_key long, fp long")
    found = written(found, "prints")
    leaves = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "leaves")
    tries, layouts = dealt(leaves.select(F.col("fp").alias("node"), "fp"), budget, crowd)
    tries = tries.repartition("turn", "trie").sortWithinPartitions("turn", "trie")
    tries = tries.select(*[F.col(c).cast("long") for c in ("turn", "trie", "fp", "node")])
    edges = written(tries.mapInArrow(_linked(layouts, budget), EDGE).where("a <> b"), "edges")
    classes = components(edges)
    members = leaves.join(classes, leaves["fp"] == classes["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("class")
    )
    members = finished(members, "classes", edges, classes, leaves)
    # a written table rather than an aggregate, so that the joins may split a hot class
    ids = written(members.groupBy("class").agg(F.min("least").alias("component_id")), "ids")
    both = finished(members.join(ids, "class").select("fp", "class", "component_id"), "members", members, ids)
    return finished(found.join(both, "fp").select("doc_id", "text_key", "fp", "class", "component_id"), "near", found, both)


def set_prints(hashes: np.ndarray, count: int = PRINTS) -> list[int]:
    """``count`` SimHashes, as signed longs, of a set of hashes: the first of the hashes as they are, the others of turned ones."""
    odd = np.random.default_rng(7).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    odd[0] = 1
    ones = np.zeros(64 * count, np.int64)
    for at in range(0, len(hashes), 1 << 10):
        part = hashes[at : at + (1 << 10), None] * odd
        part[:, 1:] ^= part[:, 1:] >> np.uint64(32)
        bits = np.unpackbits(part.astype("<u8").view(np.uint8), axis=1, bitorder="little")
        ones += np.add.reduce(bits, axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8").tolist()


def near_prints(held: DataFrame, budget: int = BITS, crowd: int = CROWD) -> DataFrame:
    """Groups (key, node) of ``held`` (node, prints) that chain by ``budget`` bits at most in one of their fingerprints.

    The join of ``near_duplicates``, with tries of their own for each place in ``prints``.  A group is what one
    trie links, so any two nodes that a fingerprint brings together share a group.  Nodes in no group are left out.
    """
    spread = written(held.select("node", F.posexplode("prints").alias("print", "fp")), "prints")
    leaves = written(spread.groupBy("print", "fp").agg(F.count(F.lit(1)).alias("nodes")), "leaves")
    spent: list[DataFrame] = []
    tries, layouts = dealt(leaves.select("print", F.col("fp").alias("node"), "fp"), budget, crowd, by=("print",), spent=spent)
    tries = tries.withColumn("turn", F.col("print") * len(layouts) + F.col("turn"))
    tries = tries.select(*[F.col(c).cast("long") for c in ("turn", "trie", "fp", "node")])
    tries = tries.repartition("turn", "trie").sortWithinPartitions("turn", "trie")
    stars = written(tries.mapInArrow(_linked(layouts, budget, ("turn", "a", "b")), f"turn long, {EDGE}"), "prints-stars")
    forget(*spent)
    place = F.floor(F.col("turn") / len(layouts)).cast("int").alias("print")
    key = F.xxhash64("turn", "b").alias("key")
    linked = stars.select(place, F.col("a").alias("fp"), key).union(stars.select(place, F.col("b").alias("fp"), key).distinct())
    same = leaves.where("nodes > 1").select("print", "fp", F.xxhash64("print", "fp").alias("key"))
    marked = written(linked.union(same), "marked")
    return finished(spread.join(marked, ["print", "fp"]).select("key", "node").distinct(), "near-prints", spread, leaves, stars, marked)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of the least values of the hashes under odd multipliers."""
    odd = np.random.default_rng(9).integers(0, 1 << 31, (BANDS * ROWS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    high = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(high), 1 << 11):
        least = np.minimum(least, (high[at : at + (1 << 11)] * odd).min(axis=1))
    digest = xxhash.xxh3_64_intdigest
    held = [digest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(held, np.uint64).view(np.int64).tolist()


def _sketched(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x or "", width)) for x in batch["text"].to_pylist()]
            nodes = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets], np.uint64).view(np.int64)
            prints, keys = (pa.array([of(x) if len(x) else [] for x in sets], pa.list_(pa.int64())) for of in (set_prints, band_keys))
            columns = [batch["doc_id"], batch["text_key"], pa.array(nodes), pa.array([len(x) for x in sets], pa.int32()), prints, keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "node", "n", "prints", "keys"])

    return run


def _shingle_sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingles(x or "", width)).view(np.int64) for x in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["node"], pa.array(sets, pa.list_(pa.int64()))], names=["node", "held"])

    return run


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets are as similar as ``SIMILAR``, compared element by element."""
    over, under = SIMILAR
    x = sets.select(F.col("node").alias("a"), F.col("held").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("held").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    union = F.size("x") + F.size("y") - both
    return pairs.join(x, "a").join(y, "b").where(both * under >= union * over).select("a", "b")


def _long_enough(n: str, m: str) -> Column:
    """Whether sets of these sizes can be as similar as ``SIMILAR``."""
    over, under = SIMILAR
    return F.least(n, m) * under >= F.greatest(n, m) * over


def _company(spread: DataFrame) -> DataFrame:
    """Groups of more than one (key, node, n), with each node's score: the members of all its groups."""
    sizes = written(spread.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "sizes")
    members = finished(spread.join(sizes, "key"), "members", sizes)
    scores = written(members.groupBy("node").agg(F.sum("members").alias("score")), "scores")
    return finished(members.join(scores, "node").select("key", "node", "n", "score"), "company", members, scores)


def _apart(groups: DataFrame, classes: DataFrame | None) -> DataFrame | None:
    """Members of groups with the class that each is in now, of groups that hold more than one; None if no group does."""
    if classes is None:
        apart, seen = observed(groups.withColumn("label", F.col("node")), "apart")
        if not seen["n"]:
            forget(apart)
        return apart if seen["n"] else None
    held = groups.join(classes, "node", "left").select("key", "node", "n", "score", F.coalesce("component", "node").alias("label"))
    held = written(held, "labelled")
    mixed = held.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("key")
    mixed, seen = observed(mixed, "mixed")
    if not seen["n"]:
        forget(held, mixed)
        return None
    return finished(held.join(mixed, "key"), "apart", held, mixed)


def _joined(classes: DataFrame | None, pairs: DataFrame, sets: DataFrame) -> DataFrame | None:
    """The classes after those of ``pairs`` that are alike are linked; what went before is deleted, and so are the pairs."""
    alike, seen = observed(_alike(pairs, sets), "alike")
    forget(pairs)
    if not seen["n"]:
        forget(alike)
        return classes
    edges = alike if classes is None else alike.union(classes.select(F.col("node").alias("a"), F.col("component").alias("b")))
    out = components(edges)
    forget(alike, *([classes] if classes is not None else []))
    return out


def _stars(apart: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(pairs of members with their group's centre, groups' centres c).

    The centre is the member with most company in all of its groups, which the original of many copies has, among
    those that are in no earlier centre's class.
    """
    free = apart
    if done is not None:
        past = done.select("key", F.col("c").alias("centre")).join(apart.select("key", F.col("node").alias("centre"), F.col("label").alias("past")), ["key", "centre"])
        free = apart.join(past.select("key", "past"), (apart["key"] == past["key"]) & (apart["label"] == past["past"]), "left_anti")
    best = free.groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("c"), F.col("n").alias("m"), F.col("label").alias("l")), F.struct("score", "node")).alias("best"))
    best = written(best.select("key", "best.*"), "centres")
    pairs = apart.join(best, "key").where((F.col("label") != F.col("l")) & _long_enough("n", "m"))
    pairs = pairs.select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()
    return written(pairs, "stars"), best


def _rare_partners(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of sets in different classes that share one of their rarest shingles.

    Two sets of ``SIMILAR`` share at least that part of the larger; so of each set's shingles, in one order
    for all, the first few (a fifth and one more, for 0.8) hold one that both have.  The first one that both have is
    followed in each set by all others that both have, so by enough of them for ``SIMILAR``: a pair meets only where that
    many are left.  The order is by how many of these sets have a shingle, so neither what very many share,
    such as a common passage, nor copies that each were changed too much bring anybody together.
    """
    over, under = SIMILAR
    nodes = written(apart.select("node", "n", "label").distinct(), "nodes")
    each = written(sets.join(nodes, "node").select("node", "n", "label", F.explode("held").alias("s")), "each")
    common = written(each.groupBy("s").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), "common")
    held = each.join(common, "s").groupBy("node", "n", "label").agg(F.sort_array(F.collect_list(F.struct("sets", "s"))).alias("by_rarity"))
    # shingles of its own come first in a set's order
    alone = F.col("n") - F.size("by_rarity")
    first = F.col("n") - F.ceil(F.col("n") * over / under) + 1 - alone
    head = held.where(first > 0).select("node", "n", "label", alone.alias("alone"), F.posexplode(F.slice("by_rarity", 1, first.cast("int"))).alias("at", "one"))
    head = finished(head.select("node", "n", "label", "one.s", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "heads", nodes, each, common)
    other = head.select("s", F.col("node").alias("b"), F.col("n").alias("m"), F.col("label").alias("other"), F.col("left").alias("after"))
    enough = F.least("left", "after") * (over + under) >= (F.col("n") + F.col("m")) * over
    apart_ = (F.col("a") < F.col("b")) & (F.col("label") != F.col("other"))
    pairs = head.withColumnRenamed("node", "a").join(other, "s").where(apart_ & enough & _long_enough("n", "m"))
    return finished(pairs.select("a", "b").distinct(), "pairs", head)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """Classes of texts that chain by pairs of ``SIMILAR`` shingle sets: a row (class, one) for each set.

    ``one`` is the first of the set's rows: null ids last, then by id and text_key.  Candidates are sets that the tries
    of ``PRINTS`` SimHash fingerprints bring together (``near_prints``).  All in a group are compared with a centre
    (``_stars``, ``ROUNDS`` times), which links most groups without pairs of their members.  As fingerprints of sets that
    are just ``SIMILAR`` may differ in more bits, groups that share one of ``BANDS`` keys of least hashes, and are not linked
    yet, come after in the same way; what these links leave apart in groups of either kind is paired by rare shingles
    (``_rare_partners``), and every such pair is compared.  A pair links only if its exact Jaccard similarity is
    ``SIMILAR`` or more.  Texts without words are one set, which is like no other.
    """
    small_batches(docs.sparkSession)
    text = docs[text_col].cast("string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = rows.mapInArrow(_sketched(width), "doc_id long, text_key long, node long, n int, prints array<long>, keys array<long>")
    found = written(found, "sketches")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    leaves = finished(found.groupBy("node", "n", "prints", "keys").agg(F.min(order).alias("one")), "sets-of", found)
    near = near_prints(leaves.select("node", "prints"))
    prints = _company(near.join(leaves.select("node", "n"), "node").select("key", "node", "n"))
    bands = _company(leaves.select("node", "n", F.explode("keys").alias("key")))
    kinds = [prints, bands]
    candidates = written(prints.select("node").union(bands.select("node")).distinct(), "candidates")
    named = candidates.join(leaves, "node").select("node", "one.doc_id", "one.text_key").alias("l")
    same = F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.text_key") == F.col("l.text_key"))
    texts = rows.alias("r").join(named, same).select("node", "text")
    sets = finished(texts.mapInArrow(_shingle_sets(width), "node long, held array<long>").dropDuplicates(["node"]), "shingles", candidates, near)
    classes = None
    for groups in kinds:
        done, spent = None, []
        for _ in range(ROUNDS):
            apart = _apart(groups, classes)
            if apart is None:
                break
            pairs, centres = _stars(apart, done)
            done = centres if done is None else done.union(centres)
            spent.append(centres)
            classes = _joined(classes, pairs, sets)
            forget(apart)
        forget(*spent)
    left = _apart(prints.union(bands), classes)
    if left is not None:
        classes = _joined(classes, _rare_partners(left, sets), sets)
        forget(left)
    forget(sets, *kinds)
    if classes is None:
        return finished(leaves.select(F.col("node").alias("class"), "one"), "classes", leaves)
    held = leaves.select("node", "one").join(classes, "node", "left").select(F.coalesce("component", "node").alias("class"), "one")
    return finished(held, "classes", leaves, classes)


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``docs`` with one row left of each class of ``near_copies``: that of the least id (null ids last), all columns kept.

    Rows that repeat an id and a text are one document.
    """
    doc, key = fresh(docs.columns, "_doc_id", "_text_key")
    classes = near_copies(docs, id_col, text_col, width)
    kept = classes.groupBy("class").agg(F.min("one").alias("one")).select("one.doc_id", "one.text_key")
    kept = finished(kept, "kept", classes).alias("k")
    held = docs.withColumn(doc, docs[id_col].cast("long")).withColumn(key, F.xxhash64(docs[text_col].cast("string")))
    same = F.col(doc).eqNullSafe(F.col("k.doc_id")) & (F.col(key) == F.col("k.text_key"))
    chosen = held.alias("d").join(kept, same, "left_semi").dropDuplicates([doc, key])
    return chosen.select(*docs.columns)


def hexadecimal(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
