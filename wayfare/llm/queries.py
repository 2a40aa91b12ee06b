"""The registered queries of the corpus operators, with SQL where it can express them."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import audit, decontaminate, licenses, mixing, neighbours, repeats, secrets, simhash, spelling, tokens, topk, toxicity, warc
from wayfare.llm.common import shared_folder, table

TOKEN_LIMIT = 1024


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Two deliveries, half of the documents each: the second is scanned against the ledger that the first has left."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    early = F.xxhash64("doc_id") < 0
    findings, ledger = secrets.scan(docs.where(early))
    findings, _ = secrets.scan(docs.where(~early), ledger, findings)
    return secrets_digest(secrets.joined_back(docs, findings))


def secrets_digest(found: DataFrame) -> DataFrame:
    spans = F.col("secret_spans")
    joined = F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def op4_repeats(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"))
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    index = warc.write_archives(table(spark, folder, "pages"), archives)
    found = warc.read_archives(index, archives)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.find_licenses(table(spark, folder, "documents"))


def categories(labels: DataFrame) -> dict:
    return {"low_quality": labels["quality"] == 0, "toxic": labels["toxic"] == 1}


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    chain = toxicity.train(docs, labels, categories(labels))
    if chain is None:
        return docs.select("doc_id", F.lit(0.0).alias("p_low_quality"), F.lit(0.0).alias("p_toxic"), F.lit(False).alias("toxic"))
    return toxicity.classify(docs, chain)


def op8_tokens(spark: SparkSession, folder: str) -> DataFrame:
    counted = tokens.token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("doc_key")


def op10_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.nearest(table(spark, folder, "embeddings"))


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.interactions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op12_exact_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.exact_top(table(spark, folder, "embeddings"))


def op13_spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_mixing,
        op3_secrets,
        op4_repeats,
        op5_warc,
        op6_licenses,
        op7_toxicity,
        op8_tokens,
        op9_decontamination,
        op10_neighbours,
        op11_filter_audit,
        op12_exact_topk,
        op13_spelling,
    )
}

_SIZES = r"""
WITH d AS (SELECT doc_id, source, md5('mix:' || doc_id) AS shuffled,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, 3 * source_size AS cap, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS place FROM s),
w AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM p),
l AS (SELECT *, cap / weight AS bar,
    (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::DOUBLE
    / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
    FROM w WINDOW b AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * (SELECT level FROM l WHERE bar >= level ORDER BY bar, place LIMIT 1)) AS target FROM l)
"""

#: SQL for the mix: the schedule slot by slot, and each source's line of shuffled documents by blocks.
_MIXING = (
    _SIZES
    + f"""
, n AS (SELECT p.source, place, source_size, target, CAST(floor(target) AS BIGINT) AS goal, (CAST(floor(target) AS BIGINT) + {mixing.BLOCK - 1}) // {mixing.BLOCK} AS needed
    FROM t JOIN (SELECT source, place FROM p) p ON p.source IS NOT DISTINCT FROM t.source WHERE source_size > 0 AND floor(target) > 0),
c AS (SELECT *, floor((sum(needed) OVER o - needed)::DOUBLE * {mixing.POINTS} / sum(needed) OVER ()) AS low, floor((sum(needed) OVER o)::DOUBLE * {mixing.POINTS} / sum(needed) OVER ()) AS high FROM n WINDOW o AS (ORDER BY place)),
slots AS (SELECT i AS slot, (i::HUGEINT * {mixing.GOLDEN}) % {mixing.POINTS} AS point FROM (SELECT unnest(range({mixing.SPAN} * (SELECT sum(needed)::BIGINT FROM n))) AS i)),
r AS (SELECT slot, place, needed, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS rank FROM slots JOIN c ON point >= low AND point < high),
o AS (SELECT row_number() OVER () AS row, d.doc_id, d.size, t.source_size, t.target, place, goal,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.shuffled, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS begins
    FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN n ON n.source IS NOT DISTINCT FROM t.source),
a AS (SELECT row, place, goal, size, repeat * source_size + begins AS a FROM o, (SELECT unnest(range({mixing.EPOCHS})) AS repeat) WHERE size > 0 AND repeat * source_size + begins < goal),
e AS (SELECT *, least(a + size, goal) AS b, unnest(range(a // {mixing.BLOCK}, (least(a + size, goal) - 1) // {mixing.BLOCK} + 1)) AS rank FROM a),
x AS (SELECT row, sum(least(b, (e.rank + 1) * {mixing.BLOCK}) - greatest(a, e.rank * {mixing.BLOCK})) AS taken, min(slot) AS first_slot FROM e JOIN r ON r.place = e.place AND r.rank = e.rank AND r.rank < needed GROUP BY row)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, first_slot FROM o LEFT JOIN x USING (row)"""
)

_SECRET_SPANS = """
(SELECT coalesce(list({{'k': {rank}, 'kind': '{kind}', 'a': ends[i] - length(found[i]), 'b': ends[i]}}) FILTER (length(counts[i]) >= {least}), [])
 FROM (SELECT unnest(range(1, len(found) + 1)) AS i, found, counts,
    list_transform(range(1, len(found) + 1), lambda j: CAST(list_sum(list_transform(gaps[1:j], lambda g: length(g))) + list_sum(list_transform(found[1:j], lambda m: length(m))) AS BIGINT)) AS ends
    FROM (SELECT regexp_extract_all(t.text, '{pattern}') AS found, regexp_extract_all(t.text, '{pattern}', {group}) AS counts, string_split_regex(t.text, '{pattern}') AS gaps)))
"""


def _spans_sql(rule: secrets.Rule, rank: int, group: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return _SECRET_SPANS.format(rank=rank, kind=rule.kind, least=rule.least, pattern=pattern, group=group)


_SECRETS = (
    "WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), f AS (SELECT doc_id, list_sort(list_concat("
    + ", ".join(
        f"CASE WHEN regexp_matches(t.text, '{r.pattern.replace(chr(39), chr(39) * 2)}') THEN {_spans_sql(r, i, r.group)} ELSE [] END"
        for i, r in enumerate(secrets.RULES)
    )
    + ")) AS x FROM t) "
    + """, g AS (SELECT doc_id, list_sort(list_transform(x, lambda s: {'a': s.a, 'k': s.k, 'b': s.b, 'kind': s.kind})) AS x FROM f),
h AS (SELECT doc_id, x, array_to_string(list_transform(x, lambda s: s.kind || ':' || s.a || ':' || s.b), ',') AS spans FROM g)
SELECT doc_id, CAST(len(list_filter(x, lambda s: s.kind = 'assign')) AS BIGINT) AS n_assign,
    CAST(len(list_filter(x, lambda s: s.kind = 'access')) AS BIGINT) AS n_access,
    CAST(len(list_filter(x, lambda s: s.kind = 'hex')) AS BIGINT) AS n_hex, sha256(spans) AS base_sha256, spans FROM h"""
)

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
c AS (SELECT *, max(page_id) OVER (PARTITION BY sha) AS chosen FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + ((((strpos('0123456789abcdef', substr(sha, CAST(5 * i // 4 + 1 AS BIGINT), 1)) - 1) * 16
        + greatest(strpos('0123456789abcdef', substr(sha, CAST(5 * i // 4 + 2 AS BIGINT), 1)) - 1, 0)) >> CAST(3 - (5 * i) % 4 AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM chosen THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM chosen THEN chosen END AS refers_to
FROM c
"""

#: Masks counted by part, as strings of failed letters, against all orders and steps.
_AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(l.toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
    FROM w LEFT JOIN l USING (doc_id)),
g AS (SELECT part, good, toxic, fails, count(*) AS n FROM m GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
    WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, step, 1) AS letter, substr(filter_order, 1, step - 1) AS before
    FROM o, (SELECT unnest(range(1, 6)) AS step)),
y AS (SELECT s.*, g.*, contains(fails, letter) AS failing, length(translate(before, fails, '')) < length(before) AS gone FROM s, g),
c AS (SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN failing AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN failing AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN failing AND NOT gone THEN n * good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN failing AND NOT gone THEN n * toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM y GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM c
"""

_TOPK = """
WITH r AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda v: floor(64 * CAST(v AS DOUBLE))) AS x FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS (SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
    FROM r q JOIN r c ON q.row <> c.row AND len(q.x) = len(c.x) WHERE q.vec_id % 20 = 0),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= 20
"""

ORACLE_SQL = {"op11_filter_audit": _AUDIT, "op12_exact_topk": _TOPK, "op2_mixing": _MIXING, "op3_secrets": _SECRETS, "op5_warc": _WARC}
