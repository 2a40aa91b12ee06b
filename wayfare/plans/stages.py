"""A graph of named tables and stages, with checkpoints that can be restored."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from wayfare.functions.rng import Ledger
from wayfare.operators import lookup
from wayfare.sources.tables import artifact_metadata, read_artifact, write_artifact


@dataclass
class Graph:
    """Tables with versions; a stage declares what it reads and writes.

    Tables are lazy DataFrames, so a version is a plan, and reading a stale one is an error of the caller
    that ``lease`` finds.
    """

    spark: SparkSession
    tables: dict[str, DataFrame] = field(default_factory=dict)
    versions: dict[str, int] = field(default_factory=dict)
    #: Draw ledgers of tables' entities, by table.
    ledgers: dict[str, Ledger] = field(default_factory=dict)
    sealed: bool = False

    def ingress(self, name: str, df: DataFrame) -> None:
        if self.sealed:
            raise ValueError("inputs are sealed")
        self._put(name, df)

    def seal(self) -> None:
        self.sealed = True

    def _put(self, name: str, df: DataFrame) -> None:
        self.tables[name] = df
        self.versions[name] = self.versions.get(name, 0) + 1

    def lease(self, name: str) -> tuple[str, int]:
        return name, self.versions[name]

    def read(self, lease: tuple[str, int]) -> DataFrame:
        name, version = lease
        if self.versions.get(name) != version:
            raise ValueError(f"{name} has changed since it was leased")
        return self.tables[name]

    def gather(self, lease: tuple[str, int], target: DataFrame, key: list[str], columns: list[str], default: dict | None = None) -> DataFrame:
        """``lookup.gather`` from a leased table: a stale lease, an unknown column or a missing key raises."""
        source = self.read(lease)
        unknown = sorted({*key, *columns} - set(source.columns))
        if unknown:
            raise ValueError(f"{lease[0]} has no columns {unknown}")
        return lookup.gather(target, source, key, columns, default)

    def invalidate(self, name: str) -> None:
        """Takes a table out; leases of it are stale from now on, also when it is written again."""
        del self.tables[name]
        self.ledgers.pop(name, None)
        self.versions[name] += 1

    def run(self, stage: str, reads: list[str], writes: list[str], operation: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]]) -> None:
        missing = [r for r in reads if r not in self.tables]
        if missing:
            raise ValueError(f"{stage} reads {missing}, which no stage has written")
        out = operation({r: self.tables[r] for r in reads})
        if set(out) != set(writes):
            raise ValueError(f"{stage} wrote {sorted(out)} and declared {sorted(writes)}")
        for name, df in out.items():
            self._put(name, df)

    def publish(self, name: str, columns: list[str]) -> DataFrame:
        return self.tables[name].select(*columns)

    def checkpoint(self, folder: str, names: list[str], metadata: dict | None = None) -> None:
        """Writes tables with their versions, and the ledgers that go with them, so that draws go on where they stood."""
        for name in names:
            held = {"version": self.versions[name], **(metadata or {})}
            if name in self.ledgers:
                held["entity"] = self.ledgers[name].entity
                write_artifact(self.ledgers[name].rows, f"{folder}/{name}-ledger")
            write_artifact(self.tables[name], f"{folder}/{name}", held)

    def restore(self, folder: str, names: list[str]) -> None:
        """Reads what ``checkpoint`` wrote; a table that differs from its manifest raises."""
        for name in names:
            self.tables[name] = read_artifact(self.spark, f"{folder}/{name}")
            held = artifact_metadata(self.spark, f"{folder}/{name}")
            self.versions[name] = held["version"]
            if "entity" in held:
                self.ledgers[name] = Ledger(read_artifact(self.spark, f"{folder}/{name}-ledger"), held["entity"])
