"""Draws by channel and step that go on after a failed stage without drawing twice."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions.rng import Ledger, seeded_normals, seeded_uniforms
from wayfare.sources.tables import artifact_metadata, fingerprint, read_artifact, write_artifact


class DrawService:
    """A ledger for each channel (a table of entities) and step.

    A step begins with every entity at the start of the stream that its id, channel and step name.  Each
    reservation is an artifact in ``place``: the draws, and how far every entity then is.  It counts once its manifest is written,
    so what a lost task or a failed stage leaves behind is written anew, and a stage that runs again gets the draws it had:
    reservations of a step are known by their order, and one that asks for something else than before raises.  Steps do not
    overlap, and one that has ended cannot begin again.  All is in ``place``: a new service over the same folder goes on.
    """

    def __init__(self, spark: SparkSession, place: str, channels: Mapping[str, tuple[DataFrame, str]], base: int = 0):
        self.spark, self.place, self.channels, self.base = spark, place.rstrip("/"), dict(channels), base
        self.open: str | None = None
        self.taken: Counter[str] = Counter()

    def _there(self, path: str) -> bool:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return held.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(held)

    def _remove(self, path: str) -> None:
        held = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(held, True)

    def ended(self, step: str) -> bool:
        return self._there(f"{self.place}/{step}/_ended/_SUCCESS")

    def begin(self, step: str) -> None:
        """Begins a step, or takes it up again from its first reservation if it did not end."""
        if self.open is not None:
            raise ValueError(f"{self.open} has not ended")
        if self.ended(step):
            raise ValueError(f"{step} has ended")
        self.open, self.taken = step, Counter()

    def end(self) -> None:
        if self.open is None:
            raise ValueError("no step has begun")
        self.spark.createDataFrame([(self.open,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.place}/{self.open}/_ended")
        self.open = None

    @contextmanager
    def step(self, name: str) -> Iterator[DrawService]:
        """A step that ends with the block; an exception leaves it to be taken up again."""
        self.begin(name)
        try:
            yield self
        except BaseException:
            self.open = None
            raise
        self.end()

    def uniforms(self, channel: str, count: int, only: DataFrame | None = None) -> DataFrame:
        """(entity, draws): ``count`` uniforms of each entity of the channel, or of the rows of ``only``."""
        return self._reserve({"kind": "uniform", "count": count}, channel, only)

    def normals(self, channel: str, count: int, mu: float = 0.0, sigma: float = 1.0, only: DataFrame | None = None) -> DataFrame:
        """(entity, draws): normals, which move an entity on by ``count``, however many uniforms they take.

        With no variance nothing is drawn, but the ledger moves on alike.
        """
        return self._reserve({"kind": "normal", "count": count, "mu": mu, "sigma": sigma}, channel, only)

    def offsets(self, channel: str) -> DataFrame:
        """(entity, seed, rng_offset) after the last reservation of the open step."""
        return self._ledger(channel, self.taken[channel])

    def _path(self, channel: str, number: int) -> str:
        return f"{self.place}/{self.open}/{channel}-{number}"

    def _ledger(self, channel: str, number: int) -> DataFrame:
        entities, entity = self.channels[channel]
        if number == 0:
            return Ledger.start(entities, entity, self.base, channel, self.open).rows
        return read_artifact(self.spark, self._path(channel, number - 1), verify=False).select(entity, "seed", "rng_offset")

    def _reserve(self, asked: dict, channel: str, only: DataFrame | None) -> DataFrame:
        if self.open is None:
            raise ValueError("no step has begun")
        if asked["count"] < 1:
            raise ValueError("a positive number of draws")
        entity = self.channels[channel][1]
        path = self._path(channel, self.taken[channel])
        asked = asked | {"rows": None if only is None else fingerprint(only.select(F.col(entity).cast("string")))}
        if self._there(f"{path}/_manifest_json/_SUCCESS"):
            if artifact_metadata(self.spark, path) != asked:
                raise ValueError(f"reservation {self.taken[channel]} of {channel} in {self.open} asked for something else before")
        else:
            self._remove(path)
            write_artifact(self._drawn(asked, self._ledger(channel, self.taken[channel]), entity, only), path, asked)
        self.taken[channel] += 1
        return read_artifact(self.spark, path, verify=False).where("draws is not null").select(entity, "draws")

    def _drawn(self, asked: dict, rows: DataFrame, entity: str, only: DataFrame | None) -> DataFrame:
        count = asked["count"]
        if only is not None:
            marked = only.select(entity).withColumn("_takes", F.lit(True))
            held = marked.agg(F.count(F.lit(1)), F.count_distinct(entity)).first()
            if held[0] != held[1] or rows.join(marked, entity, "left_semi").count() != held[0]:
                raise ValueError("rows must be entities of the channel, each once")
            rows = rows.join(marked, entity, "left")
        takes = F.lit(True) if only is None else F.coalesce("_takes", F.lit(False))
        if asked["kind"] == "uniform":
            draws = seeded_uniforms(F.col("seed"), F.col("rng_offset"), count)
        elif asked["sigma"] == 0 and math.isfinite(asked["mu"]):
            draws = F.array_repeat(F.lit(float(asked["mu"])), count)
        else:
            draws = F.transform(seeded_normals(F.col("seed"), F.col("rng_offset"), count), lambda x: x * asked["sigma"] + asked["mu"])
        drawn = rows.where(takes).select(entity, "seed", (F.col("rng_offset") + count).alias("rng_offset"), draws.alias("draws"))
        if only is None:
            return drawn
        return drawn.unionByName(rows.where(~takes).select(entity, "seed", "rng_offset", F.lit(None).cast("array<double>").alias("draws")))
