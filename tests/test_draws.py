"""Draws beside NumPy's legacy generator, and the service that hands them out."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfare.functions import rng, twister
from wayfare.operators.draws import DrawService
from wayfare.plans.session import workspace


def test_uniforms_and_normals_are_those_of_numpy(monkeypatch):
    monkeypatch.setattr(twister, "SEEDS", 7)
    rows = [(s, o) for s in (0, 1, 5489, (1 << 32) - 1, 123456789) for o in (0, 1, 110, 113, 226, 227, 310, 311, 312, 313, 500, 623, 624, 1000, 1871)]
    seeds, offsets = np.array([r[0] for r in rows], np.uint32), np.array([r[1] for r in rows])
    for count in (1, 3, 8, 700):
        drawn, normal = twister.uniforms(seeds, offsets, count), twister.normals(seeds, offsets, count)
        for i, (s, o) in enumerate(rows):
            for got, draw in ((drawn, "random_sample"), (normal, "standard_normal")):
                state = np.random.RandomState(s)
                state.random_sample(o)
                assert got[i].tolist() == getattr(state, draw)(count).tolist()
    assert twister.uniforms(seeds[:0], offsets[:0], 2).shape == (0, 2) and twister.normals(seeds[:0], offsets[:0], 3).shape == (0, 3)


def test_normals_draw_on_when_many_pairs_are_rejected(monkeypatch):
    monkeypatch.setattr(twister, "SPARE", 1)
    got = twister.normals(np.arange(300, dtype=np.uint32), np.zeros(300, int), 1)
    assert got[:, 0].tolist() == [np.random.RandomState(i).standard_normal() for i in range(300)]


def held(df):
    return {r.e: r.draws for r in df.collect()}


def service_of(spark, place, n=4):
    people = spark.range(n).select(F.col("id").alias("e"), F.lit("x").alias("draws"))
    return DrawService(spark, place, {"persons": (people, "e"), "tours": (people, "e")}, 5)


def stream(spark, step, entity, channel="persons"):
    seed = spark.range(1).select(rng.row_seed(F.lit(entity), 5, channel, step)).first()[0]
    return np.random.RandomState(seed)


def test_a_step_taken_up_again_draws_what_it_had(spark):
    place = workspace(spark, "service")
    some = spark.createDataFrame([(1,), (2,)], "e long")
    service = service_of(spark, place)
    with pytest.raises(RuntimeError), service.step("one"):
        first = held(service.uniforms("persons", 2))
        raise RuntimeError
    service = service_of(spark, place)
    with service.step("one"):
        assert held(service.uniforms("persons", 2)) == first
        second = held(service.uniforms("persons", 1, some))
        tours = held(service.uniforms("tours", 1))
        assert {r.e: r.rng_offset for r in service.offsets("persons").collect()} == {0: 2, 1: 3, 2: 3, 3: 2}
        normal = held(service.normals("persons", 1, only=some))
        flat = held(service.normals("persons", 2, 1.5, 0.0))
        assert {r.e: r.rng_offset for r in service.offsets("persons").collect()} == {0: 4, 1: 6, 2: 6, 3: 4}
    for e in range(4):
        state = stream(spark, "one", e)
        assert first[e] == state.random_sample(2).tolist() and flat[e] == [1.5, 1.5]
        assert tours[e] == stream(spark, "one", e, "tours").random_sample(1).tolist()
        if e in (1, 2):
            assert second[e] == state.random_sample(1).tolist() and normal[e] == [state.standard_normal()]
    assert set(second) == set(normal) == {1, 2}
    with service.step("two"):
        assert held(service.uniforms("persons", 1))[3] == stream(spark, "two", 3).random_sample(1).tolist()


def test_a_torn_reservation_is_written_anew(spark):
    place = workspace(spark, "torn")
    service = service_of(spark, place)
    spark.range(3).write.parquet(f"{place}/one/persons-0/data")
    with service.step("one"):
        assert held(service.uniforms("persons", 1))[0] == stream(spark, "one", 0).random_sample(1).tolist()


def test_a_service_refuses(spark):
    place = workspace(spark, "refuses")
    service = service_of(spark, place)
    with pytest.raises(ValueError, match="no step"):
        service.uniforms("persons", 1)
    service.begin("one")
    with pytest.raises(ValueError, match="not ended"):
        service.begin("two")
    with pytest.raises(ValueError, match="positive"):
        service.uniforms("persons", 0)
    for bad in ([(1,), (1,)], [(1,), (99,)]):
        with pytest.raises(ValueError, match="each once"):
            service.uniforms("persons", 1, spark.createDataFrame(bad, "e long"))
    service.uniforms("persons", 1)
    again = service_of(spark, place)
    again.begin("one")
    with pytest.raises(ValueError, match="something else"):
        again.uniforms("persons", 2)
    again = service_of(spark, place)
    again.begin("one")
    again.end()
    with pytest.raises(ValueError, match="has ended"):
        service_of(spark, place).begin("one")
