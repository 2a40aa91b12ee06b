"""Operators 11 to 13 against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from wayfare.llm import audit, spelling, topk

DOC = "doc_id long, text string, source string, word string, n string, mask string, part string, sha string, key string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, s, "w", "n", "m", "p", "h", "k") for i, t, s in rows], DOC)


def text_of(rng, n):
    parts = ["alpha", "beta", "Gamma", "delta", "ÉPSILON", "zeta", "#", "50%", "É"] + [f"w{i}" for i in range(60)]
    return rng.choice([" ", "\t", "\x0b", "\x85"]).join(rng.choice(parts) for _ in range(n))


def plain_failures(i, text, rows):
    held = re.findall(r"[^\x20\x09-\x0D]+", text)
    return "".join(
        letter
        for letter, fails in (
            ("A", len(held) < 200),
            ("B", 100 * len(set(held)) < 50 * len(held)),
            ("C", 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text)),
            ("D", any(c in "#$%&*|" for c in text)),
            ("E", i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows)),
        )
        if fails
    )


def plain_audit(rows, labels):
    out = {}
    docs = []
    for i, text, source in rows:
        own = [(q, t) for j, q, t in labels if j == i and i is not None]
        docs.append((source or "", plain_failures(i, text or "", rows), any(q == 1 for q, _ in own), any(t == 1 for _, t in own)))
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], set(order[: step - 1])
                removed = [d for d in own if letter in d[1] and not before & set(d[1])]
                out[part, order, step] = [
                    sum(not (before | {letter}) & set(d[1]) for d in own),
                    len(removed),
                    sum(letter in d[1] and bool(before & set(d[1])) for d in own),
                    sum(d[1] == letter for d in own),
                    sum(d[2] for d in removed),
                    sum(d[3] for d in removed),
                ]
    shapley = Counter()
    for (part, order, step), x in out.items():
        shapley[part, order[step - 1]] += x[1]
    return sorted((*k, *x, shapley[k[0], k[1][k[2] - 1]]) for k, x in out.items())


def test_filter_audit(spark):
    rng = random.Random(11)
    rows = [(i, text_of(rng, rng.choice([3, 150, 199, 200, 201, 260])), rng.choice(["s", "t", None, ""])) for i in range(40)]
    rows += [(rng.randint(0, 60), rng.choice(rows)[1], "s") for _ in range(20)]
    rows += [rows[3], rows[3], (None, rows[3][1], "t"), (None, None, None), (61, None, "u"), (62, "", "u"), (63, "A" * 60 + " b" * 200, "s")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 70, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    held = spark.createDataFrame([(*x, "x") for x in labels], "doc_id long, quality int, toxic int, text string")
    got = audit.interactions(docs_of(spark, rows), held).collect()
    assert sorted(map(tuple, got)) == plain_audit(rows, labels)
    assert audit.interactions(docs_of(spark, []), held).count() == 0
    none = spark.createDataFrame([], held.schema)
    assert sum(r.good_lost + r.toxic_lost for r in audit.interactions(docs_of(spark, rows[:5]), none).collect()) == 0


def test_long_texts_are_split_at_white_space(monkeypatch):
    rng = random.Random(12)
    texts = [text_of(rng, n).encode() for n in (0, 1, 220, 4000)] + [b"x" * 500, b" " * 500, b"a " * 300]
    want = [audit.text_failures(t) for t in texts]
    monkeypatch.setattr(audit, "SLICE", 40)
    assert [audit.text_failures(t) for t in texts] == want


@pytest.mark.parametrize("count", [1, 127, 255, 256, 65_535, 65_536, 1 << 40, (1 << 62) + 5])
def test_counters_hold_every_count(count):
    width = audit.field_width(2 * count)
    fields = [audit.outcomes(m, True, False) for m in (0b10110, 0b00001)]
    got = audit.unpacked(sum(count * audit.packed(f, width) for f in fields), width)
    assert (got == sum(count * f.astype(np.int64) for f in fields)).all()


VECTOR = "vec_id long, embedding array<double>, row string, score string, rank int"


def plain_top(rows, k=20):
    held = [(n, i, [int(np.floor(64.0 * x)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, v in held:
        if i is None or i % 20:
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j is None, j or 0) for m, j, w in held if m != n and len(w) == len(v))
        out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(scores[:k], 1)]
    return sorted(out, key=repr)


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "r", "s", 1) for i, v in rows], VECTOR)


@pytest.mark.parametrize("scale", [1.0, 1e6, 4e6])
def test_exact_top(spark, scale):
    rng = np.random.default_rng(3)
    rows = [(int(i), (scale * rng.normal(size=6)).tolist()) for i in rng.integers(-40, 300, 240)]
    hot = (scale * np.full(6, 0.9)).tolist()
    rows += [(int(i), hot) for i in rng.integers(0, 400, 120)]
    rows += [(None, hot), (None, rows[0][1]), (20, None), (40, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (60, [float("nan")] * 6), (80, [float("inf")] * 6)]
    rows += [(100, [0.0] * 6), (120, [1.0, 2.0]), (140, [0.5, 2.0]), (141, [0.5, -2.0]), (160, []), (161, [])]
    got = topk.exact_top(vectors_of(spark, rows))
    assert [f"{n} {t}" for n, t in got.dtypes] == ["query_id bigint", "rank int", "vec_id bigint", "score bigint"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows)


def test_exact_top_of_few_and_none(spark):
    rows = [(0, [0.5, 1.0]), (1, [0.25, -1.0]), (2, [1.5, 0.015])]
    got = topk.exact_top(vectors_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows)
    assert topk.exact_top(vectors_of(spark, [])).count() == 0
    with pytest.raises(Exception, match="OverflowError"):
        topk.exact_top(vectors_of(spark, [(0, [1e15]), (1, [1e15])]))


def test_exact_top_over_many_nodes(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, np.round(rng.normal(size=8), 1).tolist()) for i in range(400)]
    monkeypatch.setattr(topk, "NODES", 9)
    monkeypatch.setattr(topk, "BLOCKS", 5)
    got = topk.exact_top(vectors_of(spark, rows))
    assert sorted(map(tuple, got.collect()), key=repr) == plain_top(rows)


def plain_vocabulary(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{i}:{word}".encode())
            if i is not None and h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def plain_spelling(rows):
    held = plain_vocabulary(rows)
    near, form = defaultdict(set), {}
    for w in held:
        near[w] = {x for x in held if one_edit(w, x)}
        if near[w]:
            best = min(near[w], key=lambda x: (-held[x], x))
            if held[best] >= 2 * held[w]:
                form[w] = best
    out = []
    for w, n in held.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near[w]), held.get(form.get(w))))
    return sorted(out, key=lambda x: x[0])


def test_spelling_variants(spark):
    rng = random.Random(13)
    base = ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(40)]
    long = "".join(rng.choice("xyzÿ") for _ in range(3000))
    rows = []
    for i in range(150):
        held = []
        for _ in range(60):
            w = base[min(rng.randrange(40), rng.randrange(40), rng.randrange(40))]
            k = rng.randrange(len(w) + 1)
            w = rng.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + rng.choice("abé×") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            held.append(w)
        rows.append((rng.choice([i, i, i, None]), rng.choice([" ", "-", "1"]).join(held)))
    rows += [(7, rows[7][1])] * 3 + [(None, None), (500, None), (501, ""), (502, "Ça Ça"), *[(i, f"{long} {long[:1500]}q{long[1500:]}") for i in range(600, 604)]]
    rows += [(i, long[:-1] + " chain chains chainss chainsss") for i in range(700, 704)] + [(800 + i, "chainss chainsss " * 3 + "chainsss " * 30) for i in range(3)]
    docs = docs_of(spark, [(i, t, "s") for i, t in rows])
    got = spelling.spelling_variants(docs).collect()
    want = plain_spelling(rows)
    assert sorted(map(tuple, got), key=lambda x: x[0]) == want
    assert sum(x[1] is not None for x in want) > 20 and any(x[1] != x[2] for x in want if x[1]) and any(len(x[0]) > 2990 and x[4] for x in want)
    assert spelling.spelling_variants(docs_of(spark, [])).count() == 0


def test_one_code_point_goes_by_the_hash():
    before = zlib.crc32(b"5:")
    runs = [f"run{'abcdefghij'[i % 10]}{'abcdefghij'[i // 10 % 10]}{'abcdefghij'[i // 100]}" for i in range(1000)]
    got = {r: spelling.noted(r, before) for r in runs}
    for r, w in got.items():
        h = zlib.crc32(f"5:{r}".encode())
        assert w == (r if h % 97 else r[: h % len(r)] + r[h % len(r) + 1 :])
    assert 0 < sum(r != w for r, w in got.items()) < 40


def test_neighbourhoods_are_full_and_hold_each_word_once():
    rng = random.Random(14)
    for length, alphabet in ((1, 2), (5, 3), (7, 4), (9, 2)):
        words = ["".join(rng.choice("abcdefgé") for _ in range(length)) for _ in range(30)]
        symbols = spelling.symbols_of(words, alphabet)

        def hashed(word, alphabet=alphabet):
            return int(spelling.own_hash(np.array([word], np.int64).reshape(1, -1), alphabet)[0])

        hashes, held = spelling.neighbourhood(symbols, alphabet)
        pieces = [spelling.neighbourhood(symbols, alphabet, slice(a, min(a + 2, length + 1))) for a in range(0, length + 1, 2)]
        for i, row in enumerate(symbols.tolist()):
            near = {tuple(row)}
            for k in range(length + 1):
                near |= {(*row[:k], *row[k + 1 :])} if k < length else set()
                near |= {(*row[:k], s, *row[k:]) for s in range(alphabet)} | ({(*row[:k], s, *row[k + 1 :]) for s in range(alphabet)} if k < length else set())
            want = sorted(hashed(x) for x in near)
            assert sorted(hashes[i][held[i]].tolist()) == want
            assert sorted(x for h, c in pieces for x in h[i][c[i]].tolist()) == want


def test_the_filter_keeps_every_hash_of_the_vocabulary(spark, monkeypatch):
    rng = np.random.default_rng(16)
    hashes = np.r_[rng.integers(-(1 << 63), 1 << 63, 500, dtype=np.int64), [0, -1, (1 << 63) - 1, -(1 << 63), (1 << 15) - 1, 1 << 15]]
    for bits in (16, 27):
        monkeypatch.setattr(spelling, "FILTER", bits)
        kept = spelling.marks(spark.createDataFrame([(int(h),) for h in hashes], "h long"))
        assert len(kept) == 1 << bits - 3 and spelling.marked(kept, hashes.view(np.uint64)).all()
        others = rng.integers(-(1 << 63), 1 << 63, 20_000, dtype=np.int64)
        assert spelling.marked(kept, others.view(np.uint64)).mean() < (0.02 if bits == 16 else 0.001)


def test_spelling_broadcasts_no_table(spark):
    """Neighbourhoods are many times the words that Spark takes them for; no table may be broadcast, however small it seems."""
    words = [f"{a}{b}llo{c}" for a in "bcdfgh" for b in "aeiou" for c in "wxyz"]
    rows = [(i, " ".join(words)) for i in range(4)]
    key = "spark.sql.maxBroadcastTableSize"
    before = spark.conf.get(key)
    spark.conf.set(key, "1b")
    try:
        got = spelling.spelling_variants(docs_of(spark, [(i, t, "s") for i, t in rows])).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted(map(tuple, got), key=lambda x: x[0]) == plain_spelling(rows)
