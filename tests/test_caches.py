"""Caches by content: what is unchanged is found again, and whatever changed is not."""

from __future__ import annotations

import os
from pathlib import Path

import pytest

from wayfare.operators.spec import Spec, read_document, write_document
from wayfare.plans.session import workspace
from wayfare.sources.caches import NumericInputs, SpecificationFiles, bits, source_digest

TYPES = {"zone": "long", "jobs": "double", "open": "boolean"}
TEXT = "zone,jobs,open,name\n1,2.5,true,a\n2,-0.0,false,b\n3,,true,c\n4,NaN,true,d\n"


@pytest.fixture
def inputs(spark, tmp_path):
    path = tmp_path / "land.csv"
    path.write_text(TEXT)
    return NumericInputs(spark, workspace(spark, "inputs")), path


def rewritten(path: Path, old: str, new: str) -> None:
    """Changes bytes, but neither size nor times."""
    times = (path.stat().st_atime_ns, path.stat().st_mtime_ns)
    assert len(old) == len(new)
    path.write_text(path.read_text().replace(old, new))
    os.utime(path, ns=times)


def test_an_unchanged_file_is_found_again(inputs):
    cache, path = inputs
    fresh = cache.read(str(path), TYPES)
    cache.prepare(str(path), TYPES)
    again = cache.read(str(path), TYPES)
    assert [e["hit"] for e in cache.events] == [False, True] and cache.hits == 1
    assert repr(sorted(again.collect())) == repr(sorted(fresh.collect())) and again.dtypes == fresh.dtypes
    assert "table" in again.inputFiles()[0] and "land.csv" in fresh.inputFiles()[0]
    with pytest.raises(FileExistsError):
        cache.prepare(str(path), TYPES)


def test_a_changed_byte_or_type_is_another_table(inputs):
    cache, path = inputs
    cache.prepare(str(path), TYPES)
    rewritten(path, "2.5", "3.5")
    assert sorted(r.jobs for r in cache.read(str(path), TYPES).where("zone = 1").collect()) == [3.5]
    rewritten(path, "3.5", "2.5")
    cache.read(str(path), TYPES | {"jobs": "float"})
    cache.read(str(path), {"zone": "long"})
    cache.read(str(path), TYPES)
    assert [e["hit"] for e in cache.events] == [False, False, False, True]


def test_a_cached_table_that_was_touched_raises(spark, inputs):
    cache, path = inputs
    cache.prepare(str(path), TYPES)
    place = cache._place(cache.identity(str(path), TYPES))
    table = spark.read.parquet(f"{place}/table").collect()
    spark.createDataFrame([(r.zone, 0.0 if r.zone == 2 else r.jobs, r.open) for r in table], "zone long, jobs double, open boolean").write.mode("overwrite").parquet(f"{place}/table")
    with pytest.raises(ValueError, match="has changed"):
        cache.read(str(path), TYPES)


def test_a_torn_preparation_is_no_cache(spark, inputs):
    cache, path = inputs
    place = cache._place(cache.identity(str(path), TYPES))
    spark.range(1).write.parquet(f"{place}/table")
    assert cache.read(str(path), TYPES).count() == 4 and cache.hits == 0
    cache.prepare(str(path), TYPES)
    assert cache.read(str(path), TYPES).count() == 4 and cache.hits == 1


def test_what_is_refused(inputs):
    cache, path = inputs
    for types in ({"name": "string"}, {}):
        with pytest.raises(ValueError, match="numeric"):
            cache.read(str(path), types)
    with pytest.raises(ValueError, match="no columns"):
        cache.read(str(path), {"rooms": "int"})
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cache.read(str(path), {"name": "int"}).collect()


def test_bits_tell_zeros_apart(spark):
    a, b = (spark.createDataFrame([(x, 1)], "x double, i int") for x in (0.0, -0.0))
    assert bits(a) != bits(b) and bits(a) == bits(spark.createDataFrame([(0.0, 1)], "x double, i int"))


def test_digests(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, text in (("one.csv", "1"), ("two.csv", "2")):
        (tmp_path / "a" / name).write_text(text)
    first = source_digest(spark, str(tmp_path / "a"))
    (tmp_path / "a" / "one.csv").write_text("2")
    (tmp_path / "a" / "two.csv").write_text("1")
    assert source_digest(spark, str(tmp_path / "a")) != first


def test_specifications_by_their_bytes(spark, tmp_path):
    spec, coefficients = tmp_path / "spec.csv", tmp_path / "coefficients.csv"
    spec.write_text("Label,Description,Expression,stay,go\nprice,,price / 10,beta,0.5\n")
    coefficients.write_text("coefficient_name,value\nbeta,0.25\n")
    files = SpecificationFiles(spark)
    first = files.get("x", str(spec), str(coefficients))
    assert files.get("x", str(spec), str(coefficients)) is first and (files.hits, files.misses) == (1, 1)
    rewritten(coefficients, "0.25", "0.75")
    second = files.get("x", str(spec), str(coefficients))
    assert (files.hits, files.misses) == (1, 2) and first.coefficients[0][0] == 0.25 and second.coefficients[0][0] == 0.75
    rewritten(coefficients, "0.75", "0.25")
    assert files.get("x", str(spec), str(coefficients)) is first


def test_documents_are_written_once_and_checked(spark, tmp_path):
    spec = Spec("x", ("stay", "go"), ("a", "b"), ("price / 10", "(zone > 3)"), ((0.1, -0.5), (0.0, 2.0)))
    place = str(tmp_path / "document")
    write_document(spark, spec, place)
    assert read_document(spark, place) == spec
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        write_document(spark, spec, place)
    (file,) = (tmp_path / "document").glob("part-*")
    changed = file.read_text().replace("0.1", "0.2")
    (tmp_path / "changed").mkdir()
    (tmp_path / "changed" / "part-0.txt").write_text(changed)
    with pytest.raises(ValueError, match="changed after"):
        read_document(spark, str(tmp_path / "changed"))
