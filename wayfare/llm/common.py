"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: What lies between the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


#: Folders of sessions on one machine that set none, by application.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and every executor see: ``spark.checkpoint.dir``.

    Where the session has none (tests on one machine) it is a temporary folder.
    """
    name = spark.sparkContext.applicationId
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if name not in _OWN:
            _OWN[name] = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        folder = _OWN[name]
    return f"{folder.rstrip('/')}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: ``df`` as a Parquet table in the shared folder.

    Later jobs reread the table when an executor is lost.  The shuffle files of the
    jobs that made it are of no more use, so Spark is told to delete them when they end.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def observed(df: DataFrame, name: str, *sums: Column) -> tuple[DataFrame, dict[str, object]]:
    """``df`` as a written table, and its number of rows, ``n``, and ``sums``, which the job that writes it takes."""
    seen = Observation()
    out = written(df.observe(seen, F.count(F.lit(1)).alias("n"), *sums), name)
    return out, seen.get


def forget(*tables: DataFrame) -> None:
    """Deletes written tables that no later job reads."""
    for df in tables:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(df._written_to)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def finished(df: DataFrame, name: str, *read: DataFrame) -> DataFrame:
    """``df`` as a written table, and the tables that it was made from deleted."""
    out = written(df, name)
    forget(*read)
    return out


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """Bounds the Arrow batches of texts that JVM and Python hold at once, in rows and in bytes."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if int(spark.conf.get(key).rstrip("b")) > most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> list[str]:
    """``names``, each with underscores added until ``columns`` has no such name."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(edges: DataFrame, name: str = "links", most: int = 60) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, component = least reachable node).

    Alternates large-star and small-star steps: every node's larger neighbours, then
    its smaller ones, are linked to its least neighbour.  The number of edges never
    grows, no step gathers a node's neighbours, and the rounds are logarithmic in the
    longest path.  Each round is a written table, whose job also tells whether it changed anything; the last is
    returned.  Raises if ``most`` rounds do not do.
    """
    sums = F.sum(F.hash("a", "b").cast("long")).alias("x"), F.sum(F.xxhash64("a", "b") % 1000003).alias("y")
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, before = observed(ordered, name, *sums)
    for _ in range(most):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        past = now
        now, state = observed(small.where("a <> b").distinct(), name, *sums)
        forget(past)
        if state == before:
            out = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            out._written_to = now._written_to
            return out
        before = state
    raise RuntimeError(f"components not found in {most} rounds")
