"""Token counts by finite-state transducers (operator 8).

Byte-level BPE is a cascade of two machines.  The first splits a text into words: it reads
character classes with two characters of lookahead and has eight states.  The second
reads the bytes of a word, and each of its transitions is annotated with the change in the number of tokens; its
transitions are compiled from the merges when they are first taken.

The first machine is deterministic, so a chunk of text is a map from the state before it
to the state after it.  Chunks of all texts of a batch are run side by side from every
state at once, their maps compose by a parallel prefix scan, and a second run, now from
known states, marks where words start.  A chunk's count depends on the state before it alone; as the scan has
found that, the counts of the pairs (state, count) add up by running sums.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wayfare.llm.common import small_batches

END, SPACE, BLANK, QUOTE, OTHER, NUMBER, LETTER, STMD, R, V, E, L = range(12)
CLASSES = 12
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, ONE_MORE, TWO_MORE, IN_BLANKS = range(8)
STATES = 8
WORD_STARTS = 8  # flag on a state
CHUNK = 128
#: Characters that are run at once, about.
RUN = 1 << 19
#: States and words that are kept, about.
STATES_KEPT, WORDS_KEPT = 1_000_000, 1_000_000
#: Pairs of tokens of which it is known whether they stay apart.
PAIRS_KEPT = 500_000
#: Words of at most so many characters are looked up by hash.
SHORT = 64
#: Words of more bytes leave no states behind.
LONG = 1024
#: A letter before a space.
BEFORE_CUT = re.compile(r"[A-Za-z](?= )")
NEVER = 1 << 30


def _goes_to(state: int, c: int, n1: int, n2: int) -> tuple[int, bool]:
    """The state after a character of class ``c`` before ``n1`` and ``n2``, and whether it starts a word."""
    blank = c in (SPACE, BLANK)
    letter = c >= LETTER
    if state == ONE_MORE:
        return START, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == IN_LETTERS and letter or state == IN_NUMBERS and c == NUMBER:
        return state, False
    if state == IN_OTHERS and c in (OTHER, QUOTE):
        return state, False
    if state == AFTER_SPACE:
        return IN_LETTERS if letter else IN_NUMBERS if c == NUMBER else IN_OTHERS, False
    if state == IN_BLANKS and blank and n1 in (SPACE, BLANK, END):
        return state, False
    if blank:
        return (AFTER_SPACE if c == SPACE and n1 not in (SPACE, BLANK, END) else IN_BLANKS), True
    if c == QUOTE and n1 == STMD:
        return ONE_MORE, True
    if c == QUOTE and (n1, n2) in ((R, E), (V, E), (L, L)):
        return TWO_MORE, True
    return IN_LETTERS if letter else IN_NUMBERS if c == NUMBER else IN_OTHERS, True


#: Letters and numbers that Unicode 16 added, which the tokenizer library knows and Python 3.13 does not (fixed values).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
    (0x1E5F1, 0x1E5FA),
)


@cache
def machine() -> np.ndarray:
    """Transitions by (first character of a text, class, next, next but one) and state."""
    table = np.zeros((2, CLASSES, CLASSES, CLASSES, STATES), np.uint8)
    for c in range(CLASSES):
        for n1 in range(CLASSES):
            for n2 in range(CLASSES):
                for state in range(STATES):
                    for first in (0, 1):
                        to, starts = _goes_to(START if first else state, c, n1, n2)
                        table[first, c, n1, n2, state] = to | (WORD_STARTS if starts else 0)
    return table.reshape(-1, STATES)


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            table[point] = LETTER
        elif kind == "N":
            table[point] = NUMBER
    for ranges, kind in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    # white space is a fixed list of Unicode's
    for point in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        table[point] = BLANK
    table[32], table[39] = SPACE, QUOTE
    for chars, kind in (("stmd", STMD), ("r", R), ("v", V), ("e", E), ("l", L)):
        for x in chars:
            table[ord(x)] = kind
    return table


def word_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where words start in texts laid end to end, which begin at ``firsts``."""
    n = len(points)
    c = classes()[points].astype(np.int16)
    last = np.zeros(n, bool)
    last[np.r_[firsts[1:], n] - 1] = True
    n1 = np.where(last, END, np.r_[c[1:], END])
    n2 = np.where(last | np.r_[last[1:], True], END, np.r_[c[2:], END, END][:n])
    first = np.zeros(n, np.int16)
    first[firsts] = 1
    symbols = np.zeros(-(-n // CHUNK) * CHUNK, np.int16)
    symbols[:n] = ((first * CLASSES + c) * CLASSES + n1) * CLASSES + n2
    chunks = np.ascontiguousarray(symbols.reshape(-1, CHUNK).T)
    table = machine()
    states = table & (WORD_STARTS - 1)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks.shape[1], 1))
    flat = states.ravel()
    for symbol in chunks:
        maps = flat[symbol.astype(np.int32)[:, None] * STATES + maps]
    before = composed(maps)
    out = np.zeros(chunks.shape, bool)
    state, flat = before, table.ravel()
    for i, symbol in enumerate(chunks):
        step = flat[symbol.astype(np.int32) * STATES + state]
        out[i], state = step >= WORD_STARTS, step & (WORD_STARTS - 1)
    return np.flatnonzero(out.T.ravel()[:n])


def composed(maps: np.ndarray) -> np.ndarray:
    """The state before each chunk, from START: a prefix scan that composes maps over doubling distances."""
    scan, step = maps.copy(), 1
    while step < len(scan):
        scan[step:] = np.take_along_axis(scan[step:], scan[:-step], axis=1)
        step *= 2
    return np.r_[np.uint8(START), scan[:-1, START]]


class Transducer:
    """The merges of a byte-level BPE as a deterministic machine over the bytes of a word.

    A state is what has been read of a word; its last token and the number of tokens so far go with it.  The
    transition by a byte is annotated with how that number changes.  Transitions are compiled when they are first
    taken, and from the states before alone: a token t that ends here is the last one if what was read before it is
    nothing, or ends in a token that stays apart from t when both are merged.  One does, whatever else the word holds.
    """

    def __init__(self, merges: dict[tuple[str, str], int]):
        self.merges = merges
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        # bytes that print stand for themselves, others for code points from 256 up
        self.symbol = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.tokens = {*self.symbol.values(), *(a + b for a, b in merges)}
        self.longest = max(map(len, self.tokens))
        self.apart: dict[tuple[str, str], bool] = {}
        self.restart()

    def restart(self) -> None:
        """Forgets all states but the first."""
        self.to: dict[int, int] = {}
        self.emitted: dict[int, int] = {}
        self.count, self.last, self.before, self.read = [0], [""], [-1], [""]

    def merged(self, parts: list[str]) -> list[str]:
        """What is left after all merges, lowest rank first and leftmost among equals."""
        rank = self.merges.get
        while len(parts) > 1:
            ranks = [rank(x, NEVER) for x in zip(parts, parts[1:])]  # noqa: B905
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def stay_apart(self, s: str, t: str) -> bool:
        """Whether the tokens ``s`` (or nothing) and ``t`` are what the merges leave of both."""
        found = self.apart.get((s, t))
        if found is None:
            if len(self.apart) >= PAIRS_KEPT:
                self.apart.clear()
            found = self.apart[s, t] = self.merged(list(s + t)) == ([s, t] if s else [t])
        return found

    def compiled(self, key: int) -> int:
        """The state that a transition (state, byte) leads to, with its annotation."""
        state, byte = divmod(key, 256)
        suffix, origin = self.symbol[byte], state
        # the last token, sought among the suffixes of what was read
        while not (suffix in self.tokens and self.stay_apart(self.last[origin], suffix)):
            if not origin or len(suffix) > self.longest:
                raise ValueError("the merges do not make a machine: no token ends here")
            suffix, origin = self.read[origin] + suffix, self.before[origin]
        new = len(self.count)
        self.count.append(self.count[origin] + 1)
        self.last.append(suffix)
        self.before.append(state)
        self.read.append(self.symbol[byte])
        self.to[key] = new
        self.emitted[key] = self.count[new] - self.count[state]
        return new

    def run(self, word: bytes) -> int:
        """Tokens of a word: the sum of the annotations on its path."""
        if len(word) > LONG:
            return self.once(word)
        if len(self.count) > STATES_KEPT:
            self.restart()
        state = total = 0
        to, emitted = self.to, self.emitted
        for byte in word:
            key = state << 8 | byte
            after = to.get(key)
            state = self.compiled(key) if after is None else after
            total += emitted[key]
        return total


    def once(self, word: bytes) -> int:
        """The same of a very long word, whose states are not kept."""
        read = [self.symbol[b] for b in word]
        count, last = [0], [""]
        for end in range(1, len(read) + 1):
            begin = end - 1
            suffix = read[begin]
            while not (suffix in self.tokens and self.stay_apart(last[begin], suffix)):
                if not begin or len(suffix) > self.longest:
                    raise ValueError("the merges do not make a machine: no token ends here")
                begin -= 1
                suffix = read[begin] + suffix
            count.append(count[begin] + 1)
            last.append(suffix)
        return count[-1]


def powers(base: int, count: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    out = np.full(count, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Token counts of words that were run before, by hash, so that a batch looks all of its words up at once."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.up = self.down = np.zeros(0, np.uint64)
        self.known = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))] * 2

    def hashes(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each word of at most ``SHORT`` characters, from prefix sums of a polynomial modulo 2**64."""
        if len(self.up) <= len(points):
            base = int(np.random.default_rng(17).integers(1 << 60, 1 << 62)) * 8 + 5
            self.up, self.down = (powers(x, len(points) + RUN) for x in (base, pow(base, -1, 1 << 64)))
        value = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        value ^= value >> np.uint64(29)
        upto = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * self.up[: len(points)], out=upto[1:])
        held = (upto[ends] - upto[starts]) * self.down[starts] + (ends - starts).astype(np.uint64)
        held ^= held >> np.uint64(32)
        return held * np.uint64(0xD6E8FEB86659FD93)

    def emitted(self, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word of ``text``."""
        out = np.zeros(len(starts), np.int64)
        long = ends - starts > SHORT
        for i in np.flatnonzero(long):
            out[i] = self.machine.run(text[starts[i] : ends[i]].encode("utf-8"))
        own = np.flatnonzero(~long)
        if not len(own):
            return out
        names, first, place = np.unique(self.hashes(points, starts[own], ends[own]), return_index=True, return_inverse=True)
        found, missing = np.zeros(len(names), np.int64), np.ones(len(names), bool)
        for keys, values in self.known:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, names), len(keys) - 1)
                hit = keys[at] == names
                found[hit], missing = values[at[hit]], missing & ~hit
        new = np.flatnonzero(missing)
        run = self.machine.run
        for i in new.tolist():
            w = own[first[i]]
            found[i] = run(text[starts[w] : ends[w]].encode("utf-8"))
        self.learn(names[new], found[new])
        out[own] = found[place]
        return out

    def learn(self, names: np.ndarray, counts: np.ndarray) -> None:
        """Adds new words to the small table, and that to the large one when it has grown."""
        if not len(names):
            return

        def joined(a, b):
            keys, values = (np.concatenate(x) for x in zip(a, b, strict=True))
            order = np.argsort(keys)
            return keys[order], values[order]

        large, small = self.known
        small = joined(small, (names, counts))
        if len(small[0]) > 1 << 14:
            large, small = small if len(large[0]) > WORDS_KEPT else joined(large, small), (small[0][:0], small[1][:0])
        self.known = [large, small]


def counts(texts: list[str], words: Words, specials: list[str]) -> np.ndarray:
    """Tokens of each text; special strings are cut out first and emit one token each."""
    out = np.zeros(len(texts), np.int64)
    held: list[str] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if held:
            joined = "".join(held)
            points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            sizes = np.array([len(x) for x in held])
            begins = np.cumsum(sizes) - sizes
            starts = word_starts(points, begins)
            emitted = words.emitted(joined, points, starts, np.r_[starts[1:], len(points)])
            # states are known, so the counts of the scan's (state, count) pairs are running sums
            upto = np.r_[0, np.cumsum(emitted)]
            edges = np.searchsorted(starts, np.r_[begins, len(points)])
            np.add.at(out, np.array(owners), np.diff(upto[edges]))
        held.clear()
        owners.clear()
        size = 0

    for i, text in enumerate(texts):
        segments = [text]
        for special in specials:
            segments = [y for x in segments for y in _between(x, special)]
        out[i] += len(segments) // 2
        for segment in segments[::2] if len(segments) > 1 else segments:
            for piece in _pieces(segment):
                if size + len(piece) > 2 * RUN:
                    flush()
                held.append(piece)
                owners.append(i)
                size += len(piece)
        if size >= RUN:
            flush()
    flush()
    return out


def _pieces(text: str) -> Iterator[str]:
    """Long texts in parts, cut between a letter and a space, where a word starts whatever comes before and after."""
    at = 0
    while len(text) - at > RUN:
        cut = text.rfind(" ", at + 1, at + RUN)
        while cut > at and not BEFORE_CUT.match(text, cut - 1):
            cut = text.rfind(" ", at + 1, cut)
        if cut <= at:
            found = BEFORE_CUT.search(text, at + RUN - 1)
            if found is None:
                break
            cut = found.end()
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


def _between(text: str, special: str) -> list[str]:
    """What lies between occurrences of ``special``, and the occurrences, in turn."""
    parts = text.split(special)
    return [x for p in parts for x in (p, special)][:-1]


#: What this Python worker has compiled, by digest of the merges.
_COMPILED: dict[str, Words] = {}


def _counted(merges, digest: str, specials: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if digest not in _COMPILED:
            _COMPILED[digest] = Words(Transducer(merges.value))
        words = _COMPILED[digest]
        for batch in batches:
            texts = [x or "" for x in batch["text"].to_pylist()]
            sizes = pa.array([len(x.encode("utf-8")) for x in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], sizes, pa.array(counts(texts, words, specials))], names=["doc_id", "n_bytes", "n_tokens"]
            )

    return run


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of each whole text under the byte-level BPE in the file ``tokenizer``.

    Returns a row for each row: doc_id, n_bytes, n_tokens.  A null text counts as empty, with no
    tokens; long texts are chunked; nothing is shuffled.  The file's merges are broadcast
    (tens of thousands of pairs whatever the input).  At most one special string is expected.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    with open(tokenizer, encoding="utf-8") as file:
        held = json.load(file)
    pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in held["model"]["merges"]]
    merges = spark.sparkContext.broadcast({x: i for i, x in enumerate(pairs)})
    digest = hashlib.sha256(json.dumps(pairs).encode()).hexdigest()
    specials = [x["content"] for x in held["added_tokens"] if x["special"]]
    if len(specials) > 1:
        raise ValueError("more than one special string")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(_counted(merges, digest, specials), "doc_id long, n_bytes long, n_tokens long")
