"""Secret scans with an incremental ledger of blobs (operator 3), in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfare.llm.common import fresh, written


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a pattern, the group whose length counts, and the least length."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule(
        "assign",
        1,
        r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        1,
        12,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    # runs of 16 or more are the runs of one or more that are not dropped
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
LEDGER = "blob string, kind string, version int"
SPANS = "array<struct<kind:string,start:int,end:int>>"


def steps_of(text: Column, rule: Rule) -> Column:
    """For each match of ``rule``, in order: code points before it since the last (gap), its own (size), and those that count."""
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else matches
    between = F.slice(F.split(text, rule.pattern, -1), 1, F.size(matches))
    sizes = F.zip_with(between, matches, lambda gap, m: F.struct(F.length(gap).alias("gap"), F.length(m).alias("size")))
    return F.zip_with(sizes, counted, lambda a, c: F.struct(a["gap"].alias("gap"), a["size"].alias("size"), F.length(c).alias("counts")))


def placed(steps: DataFrame, key: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """(key, start, end) of the matches that count: a row for each match, whose place is the running sum of all steps before it."""
    each = steps.select(*key, F.posexplode("steps").alias("at", "step"))
    upto = F.sum(F.col("step.gap") + F.col("step.size")).over(Window.partitionBy(*key).orderBy("at"))
    least = F.coalesce(*[F.when(F.col("kind") == r.kind, F.lit(r.least)) for r in rules])
    ended = each.withColumn("end", upto).where(F.col("step.counts") >= least)
    return ended.select(*key, (F.col("end") - F.col("step.size")).cast("int").alias("start"), F.col("end").cast("int").alias("end"))


def content_address(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan(
    versions: DataFrame,
    ledger: DataFrame | None = None,
    findings: DataFrame | None = None,
    text_col: str = "text",
    rules: tuple[Rule, ...] = RULES,
) -> tuple[DataFrame, DataFrame]:
    """Scans what the ledger has not seen of ``versions`` (a row for each version of each path).

    A blob is the SHA-256 of a text.  Of the pairs of blob and rule version only those
    that are not in ``ledger`` (blob, kind, version) are scanned, each blob once however
    many paths hold it.  Returns (findings, ledger), both with what they held before:
    findings has a row (blob, kind, version, start, end) for each place.  A null text is the
    empty blob; with nothing new to scan both come back unchanged; of other columns nothing is read.
    """
    spark = versions.sparkSession
    text = F.coalesce(versions[text_col].cast("string"), F.lit(""))
    blobs = versions.select(content_address(versions[text_col]).alias("blob"), text.alias("text"))
    # one text for each blob: equal texts meet before they are scanned
    unseen = blobs.groupBy("blob").agg(F.min("text").alias("text"))
    done = F.array().cast("array<string>")
    if ledger is not None:
        known = spark.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
        held = ledger.join(F.broadcast(known), ["kind", "version"], "left_semi")
        held = held.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "kind", "version")).alias("done"))
        unseen = unseen.join(held, "blob", "left")
        done = F.coalesce("done", done)
        unseen = unseen.where(F.size(done) < len(rules))
    scans = [
        F.struct(
            F.lit(r.kind).alias("kind"),
            F.lit(r.version).alias("version"),
            F.array_contains(done, f"{r.kind}:{r.version}").alias("old"),
        )
        for r in rules
    ]
    todo = unseen.select("blob", "text", F.inline(F.filter(F.array(*scans), lambda x: ~x["old"])))
    found = F.coalesce(*[F.when((F.col("kind") == r.kind) & F.col("text").rlike(r.pattern), steps_of(F.col("text"), r)) for r in rules])
    scanned = written(todo.select("blob", "kind", "version", found.alias("steps")), "scanned")
    findings_now = placed(scanned, ["blob", "kind", "version"], rules)
    entries = scanned.select("blob", "kind", "version")
    if ledger is not None:
        entries = ledger.select("blob", "kind", "version").unionByName(entries)
    if findings is not None:
        findings_now = findings.select("blob", "kind", "version", "start", "end").unionByName(findings_now)
    return findings_now, entries


def joined_back(versions: DataFrame, findings: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with secret_blob and secret_spans (kind, start, end), by start, then in the order of ``rules``.

    All rows and columns stay; rows without a finding, null texts among them, have an empty array.  Where ``versions``
    has columns of these names, those added get an underscore more.
    """
    rank = F.array(*[F.lit(r.kind) for r in rules])
    current = F.broadcast(
        versions.sparkSession.createDataFrame([(r.kind, r.version) for r in rules], "kind string, version int")
    )
    each = findings.join(current, ["kind", "version"])
    by_blob = each.groupBy("blob").agg(
        F.sort_array(F.collect_list(F.struct("start", F.array_position(rank, F.col("kind")).alias("rank"), "end", "kind"))).alias("spans")
    )
    blob, spans, own, found = fresh(versions.columns, "secret_blob", "secret_spans", "_found_blob", "_found_spans")
    # a written table rather than an aggregate, so that the join may split a hot blob's paths
    by_blob = written(by_blob.toDF(own, found), "spans")
    held = versions.withColumn(blob, content_address(versions[text_col]))
    kept = F.transform(found, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    joined = held.join(by_blob, F.col(blob) == F.col(own), "left")
    return joined.select(*versions.columns, blob, F.coalesce(kept, F.array().cast(SPANS)).alias(spans))


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """``text`` with the union of ``spans`` (sorted by start) replaced by ``mark``."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        empty,
        lambda a, x: F.when(
            x["start"] >= a["at"],
            F.struct(
                x["end"].alias("at"),
                F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark)).alias("out"),
            ),
        ).otherwise(F.struct(F.greatest(a["at"], x["end"]).alias("at"), a["out"].alias("out"))),
    )
    return F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))
