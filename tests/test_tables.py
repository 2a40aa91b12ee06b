import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfare.functions import ieee, rng
from wayfare.functions.expressions import Compiler, UnsupportedExpression, names, skims
from wayfare.operators import aggregates, chains, inputs, lookup, sampling, timetable, tours
from wayfare.operators import skims as matrices
from wayfare.operators.spec import Spec, resolved, split_stateful, utilities
from wayfare.plans.stages import Graph
from wayfare.sources.tables import dense_matrix, read_artifact, read_cube, read_spec, write_artifact, write_cube, write_matrices


def test_ieee_functions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (float("nan"), 5.0)], "a double, b double")
    got = df.select(
        ieee.divide(F.col("a"), F.col("b")).alias("d"),
        ieee.compare(F.col("a"), "!=", F.col("a")).alias("ne"),
        ieee.compare(F.col("a"), ">", F.col("b")).alias("gt"),
        ieee.clip(F.col("a"), F.lit(0.0), F.lit(0.5)).alias("c"),
        ieee.log(F.col("b")).alias("l"),
    ).collect()
    assert got[0].d == math.inf and got[1].d == -math.inf and math.isnan(got[2].d)
    assert [r.ne for r in got] == [False, False, False, True] and [r.gt for r in got] == [True, False, False, False]
    assert [r.c for r in got[:3]] == [0.5, 0, 0] and math.isnan(got[3].c) and got[0].l == -math.inf
    assert spark.range(1).select(ieee.name_hash(F.lit("persons"))).first()[0] == 4172600430
    bands = spark.createDataFrame([(500.0, 0.0, 640.0), (2001.0, 0.0, 640.0), (20000.0, 0.0, 640.0), (0.0, 0.0, 0.0)], "p double, e double, a double")
    assert [r[0] for r in bands.select(ieee.density_band(F.col("p"), F.col("e"), F.col("a"))).collect()] == [5, 3, 1, 1]
    signs = spark.createDataFrame([(1.0, -0.0), (-1.0, -0.0), (0.0, -0.0)], "a double, b double")
    negative = [r[0] for r in signs.select(ieee.divide(F.col("a"), F.col("b"))).collect()]
    assert negative[:2] == [-math.inf, math.inf] and math.isnan(negative[2])
    wait = spark.range(1).select(ieee.lognormal_wait(F.lit(7.0), F.lit(0.0), F.lit(2.0))).first()[0]
    assert wait == pytest.approx(7.0)
    assert spark.range(1).select(ieee.sampling_correction(F.lit(2), F.lit(0.0))).first()[0] == 60.0


def test_expressions(spark):
    df = spark.createDataFrame([(-1.0, True, 1, 2.0), (0.5, False, 2, 4.0), (3.0, True, 3, 8.0)], "x double, flag boolean, count long, denom double")
    compiler = Compiler({c: F.col(c) for c in df.columns}, {"upper": 2}, {"flag"})
    value = lambda e: [r[0] for r in df.select(compiler.number(e)).collect()]
    assert value("@df.x.clip(0, upper)") == [0, 0.5, 2]
    assert value("flag & ~(x > 2)") == [1, 0, 0]
    assert value("0 < x <= 3") == [0, 1, 1]
    assert value("np.maximum(x, 1) / denom") == [0.5, 0.25, 0.375]
    assert value("count | 4") == [5, 6, 7]
    assert names("df.a + b * np.log(c)") == {"a", "b", "c"} and skims("od_skims.max('D') + odt_skims['T']") == [("od_skims", "D", "max"), ("odt_skims", "T", "plain")]
    for bad in ("open('x')", "x ** 2", "x if flag else 1", "unknown + 1", "lambda: 1", "x +"):
        with pytest.raises(UnsupportedExpression):
            compiler.compile(bad)


def test_restricted_grammar_and_stateful_rows(spark):
    df = spark.createDataFrame([(3.0, 8, 17)], "x double, start int, end int")
    narrow = Compiler({c: F.col(c) for c in df.columns}, restricted=True)
    assert df.select(narrow.number("(x > 2) * 3 - (start == 8 and not end < 3)")).first()[0] == 2.0
    for bad in ("df.x", "np.log(x)", "x.clip(0, 1)", "skims['D']", "x == 'a'"):
        with pytest.raises(UnsupportedExpression):
            narrow.compile(bad)
    spec = Spec("s", ("a",), ("p", "l", "q", "r"), ("x * 2", "_free@tt.remaining(person, start, end)", "_free / 2", "@tt.ends(df.person, df.start)"), ((1.0,), (0.0,), (2.0,), (3.0,)))
    plain, stateful = split_stateful(spec)
    assert plain.labels == ("p",) and stateful.labels == ("l", "q", "r")
    asked = Compiler({"x": F.col("x"), "_free": F.lit(4.0)}, timetable={"ends": F.lit(True), "remaining": F.lit(4)})
    assert df.select(asked.number("@tt.ends(df.person, df.start)"), asked.number("_free / 2")).first() == (1.0, 2.0)
    with pytest.raises(UnsupportedExpression):
        asked.compile("tt.unknown(x)")


def test_specification(spark, tmp_path):
    rows = [
        {"Label": "t1", "Description": "", "Expression": "x * 2", "a": "0.1", "b": "beta"},
        {"Label": "", "Description": "", "Expression": "", "a": "1", "b": "1"},
        {"Label": "z", "Description": "", "Expression": "x", "a": "0", "b": ""},
        {"Label": "l", "Description": "", "Expression": "_y@x + 1", "a": "1", "b": ""},
        {"Label": "t2", "Description": "", "Expression": "_y", "a": "", "b": "2"},
    ]
    pd.DataFrame(rows).to_csv(tmp_path / "spec.csv", index=False)
    (tmp_path / "coefs.csv").write_text("coefficient_name,value\nbeta,0.5\n")
    spec = read_spec(spark, "s", str(tmp_path / "spec.csv"), str(tmp_path / "coefs.csv"))
    assert spec.labels == ("t1", "l", "t2") and spec.terms()[0][2] == (float(np.float32(0.1)), 0.5)
    with pytest.raises(ValueError, match="no coefficient"):
        resolved(rows, {})
    document = json.loads(json.dumps(spec.document()))
    assert Spec.of_document(document) == spec
    document["rows"][0]["weights"]["a"] = 9
    with pytest.raises(ValueError):
        Spec.of_document(document)
    got = utilities(spark.createDataFrame([(3.0,)], "x double"), spec).first().utilities
    assert got == pytest.approx([0.6, 3 + 8])


def test_lookups(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k long, t string")
    source = spark.createDataFrame([(1, -0.0), (2, 5.0)], "k long, v double")
    assert sorted((r.k, r.v) for r in lookup.gather(target, source, ["k"], ["v"]).collect()) == [(1, -0.0), (2, 5.0)]
    with pytest.raises(Exception, match="missing"):
        lookup.gather(target, source.where("k = 1"), ["k"], ["v"]).collect()
    assert {r.v for r in lookup.gather(target, source.where("k = 1"), ["k"], ["v"], {"v": 7.0}).collect()} == {-0.0, 7.0}
    with pytest.raises(Exception, match="twice"):
        lookup.unique_by_key(source.union(source), ["k"]).collect()
    doubled = spark.createDataFrame([(1, 2, "y"), (1, 1, "x"), (2, 1, "z")], "k long, o int, v string")
    assert sorted(lookup.gather(target, doubled, ["k"], ["v"], order="o").select("k", "v").collect()) == [(1, "x"), (2, "z")]
    with pytest.raises(Exception, match="twice"):
        lookup.gather(target, doubled, ["k"], ["v"]).collect()
    firsts = lookup.first_by_key(spark.createDataFrame([(1, 2, "y"), (1, 1, "x")], "k long, o int, v string"), ["k"], "o")
    assert firsts.first().v == "x"
    joined = lookup.interaction(spark.createDataFrame([(10, 0, 1)], "id long, alt int, x int"), spark.createDataFrame([(10, 2)], "id long, x int"), "id")
    assert joined.first().asDict() == {"id": 10, "alt": 0, "x": 1, "x_chooser": 2}
    with pytest.raises(Exception, match="two values"):
        lookup.scattered(spark.createDataFrame([(1, 0, 1.0), (1, 0, 2.0)], "k long, s int, v double"), "k", "s", "v", 2).collect()


def test_matrices(spark):
    rows = [(o, d, p, float(9 * p + 3 * o + d)) for o in range(3) for d in range(3) for p in range(2)]
    cube = spark.createDataFrame(rows, "orig int, dest int, period int, T double")
    df = spark.createDataFrame([(0, 2, 1, 0), (-1, 1, 0, 0)], "orig int, dest int, out_period int, in_period int")
    held, columns = matrices.bind(df, cube, [("odt_skims", "T", "plain"), ("dot_skims", "T", "plain"), ("od_skims", "T", "max")])
    got = held.select(*[columns[k].alias(f"{k[0]}_{k[2]}") for k in sorted(columns)]).collect()
    assert got[0].odt_skims_plain == 11 and got[0].dot_skims_plain == 6 and got[0].od_skims_reverse == 6 and got[0].od_skims_plain == 2
    assert all(math.isnan(x) for x in got[1])
    with pytest.raises(Exception, match="not in the matrix"):
        matrices.lookup(spark.createDataFrame([(0, 9)], "orig int, dest int"), cube.where("period = 0"), ["T"], "orig", "dest").collect()
    legs = matrices.two_legs(spark.createDataFrame([(5, 0, 2)], "id int, o int, p int"), cube.where("period = 0").drop("period"), "o", "p", ["T"]).collect()
    assert sorted((r.alt_pos, r.od_T, r.dp_T) for r in legs) == [(0, 0, 2), (1, 1, 5), (2, 2, 8)]


def test_sampling(spark):
    probs, draws = [[0.05, 0.15, 0.8], [0.4, 0.3, 0.3]], [[0.99, 0.01, 0.2], [0.4, 0.0, 0.999999]]
    df = spark.createDataFrame(list(zip([20, 10], probs, draws)), "id long, p array<double>, d array<double>")
    taken = sampling.draws_taken(df, "p", "d")
    want = {(i, n): int(np.searchsorted(np.cumsum(p), x, side="right").clip(0, 2)) for i, p, d in zip([20, 10], probs, draws) for n, x in enumerate(d)}
    assert {(r.id, r.draw_no): r.choice for r in taken.collect()} == want
    long = df.select("id", F.posexplode("p").alias("alt", "prob"))
    d = df.select("id", F.posexplode("d").alias("draw_no", "rand"))
    assert {(r.id, r.draw_no): r.choice for r in sampling.sample_long(long, d, "id", "alt", "prob").collect()} == want
    packed = {(r.id, r.choice): (r.pick_count, r.rand) for r in sampling.collapsed(taken, "id").collect()}
    assert packed[20, 2] == (2, 0.99) and sum(n for n, _ in packed.values()) == 6


def test_final_choice_of_nothing(spark):
    rows = spark.createDataFrame([(1, 0, float("-inf"), 1, 0.5, 0.3), (1, 1, float("-inf"), 1, 0.5, 0.3)], "id long, choice int, u double, pick_count int, prob double, z double")
    assert sampling.final_choice(rows, "id", "u", "z", missing=99).first().choice == 99


STATES = {2: {2, 7}, 4: {4, 7}, 7: {2, 4, 6, 7}, 6: {7}}


def test_timetable_over_all_pairs(spark):
    prints = timetable.Footprints(((5, 5), (5, 6), (6, 9), (5, 9), (9, 9), (7, 8)))
    assert prints.first == 4 and prints.states(0)[1] == 6 and prints.states(2)[2:6] == [2, 7, 7, 4]
    alternatives = prints.table(spark)
    pairs = [(i * 10 + j, t) for i in range(6) for j in range(6) for t in (i, j)]
    windows = timetable.windows(spark.createDataFrame(pairs, "person_id long, tdd int"), alternatives)
    got = {(r.person_id, r.tdd) for r in timetable.feasible(windows, alternatives).collect()}
    want = set()
    for i in range(6):
        for j in range(6):
            window = [a | b for a, b in zip(prints.states(i), prints.states(j))]
            want |= {(i * 10 + j, t) for t in range(6) if not any(w in STATES.get(s, ()) for s, w in zip(prints.states(t), window))}
    assert got == want
    with pytest.raises(ValueError):
        timetable.Footprints(((6, 5),))


def test_free_runs(spark):
    df = spark.createDataFrame([(0b0010100, 3)], "w int, at int")
    row = df.select(timetable.free_runs(F.col("w"), F.col("at"), 8, True).alias("b"), timetable.free_runs(F.col("w"), F.col("at"), 8, False).alias("a")).first()
    assert (row.b, row.a) == (0, 0)
    row = df.select(timetable.free_runs(F.lit(0b1000000), F.lit(3), 8, True).alias("b"), timetable.free_runs(F.lit(0b1000000), F.lit(3), 8, False).alias("a")).first()
    assert (row.b, row.a) == (2, 2)


def test_mandatory_tours(spark):
    rows = [(10 + i, h, i, i < 2, 101 + i, 201 + i, 301 + i) for i, h in enumerate([1, 1, 2, 3, 4])]
    persons = spark.createDataFrame(rows, "person_id long, household_id long, mtf_choice int, is_worker boolean, workplace_zone_id long, school_zone_id long, home_zone_id long")
    got = tours.mandatory(persons).orderBy("person_id", "tour_type").collect()
    assert len(got) == 8
    assert [(r.tour_type, r.tour_num, r.destination, r.tour_id) for r in got[-2:]] == [(0, 2, 105, 14 * 41 + 39), (1, 1, 205, 14 * 41 + 31)]
    assert len(tours.pattern_alternatives(1)) == 3 and tours.pattern_alternatives(2) == ["HH", "HM", "HN", "MH", "MM", "MN", "NH", "NM", "NN", "MMJ", "MNJ", "NMJ", "NNJ"]
    assert dict(tours.pattern_terms(2))["joint"] == ["MMJ", "MNJ", "NMJ", "NNJ"]


def hour_by_hand(trip, base, low, high, attempt, scale):
    """One departure in plain floats; None if it fails."""
    inside = [p if low <= base + i <= high else 0.0 for i, p in enumerate(trip["probs"])]
    mass = sum(inside)
    whole = mass if scale and mass > 0 else 1.0
    fail = (0.0 if mass > 0 else 1.0) if scale else 1 - min(1.0, mass)
    left = trip["draws"][attempt]
    for i, p in enumerate([*(p / whole for p in inside), fail]):
        left -= p
        if left <= 0:
            return base + i if i < len(inside) else None
    best = max(range(len(inside)), key=lambda i: inside[i] / whole)
    return base + best if inside[best] / whole >= fail else None


def leg_by_hand(trips, base, attempt, last, floor=None):
    """({trip: hour}, failures) of one attempt at one leg, written as a recursion over what is left of it."""
    if not trips:
        return {}, 0
    inbound = not trips[0]["outbound"]
    trip, rest = (trips[-1], trips[:-1]) if inbound else (trips[0], trips[1:])
    low = floor if inbound and floor is not None else trip["low"]
    if trip["fixed_hour"] >= 0:
        hours, failures = leg_by_hand(rest, base, attempt, last, floor)
        return hours | {trip["trip_id"]: trip["fixed_hour"]}, failures
    edge = trip["trip_count"] == trip["trip_num"] if inbound else trip["trip_num"] == 1
    hour = hour_by_hand(trip, base, low, trip["high"], attempt, edge)
    wall = trip["high"] if inbound else low
    moved = [t | ({"high": wall if hour is None else hour} if inbound else {"low": wall if hour is None else hour}) for t in rest]
    hours, failures = leg_by_hand(moved, base, attempt, last, floor)
    shown = hour if hour is not None else wall if last else -1
    return hours | {trip["trip_id"]: shown}, failures + (hour is None)


def tour_by_hand(trips, base, attempts):
    """{trip: (hour, draws used, failures of the tour)}: each leg takes its first clean attempt, or the last."""
    legs = [[t for t in trips if t["outbound"] is way] for way in (True, False)]
    out = [leg_by_hand(legs[0], base, i, i == attempts - 1) for i in range(attempts)]
    clean = next((i for i, (_, bad) in enumerate(out) if not bad), attempts - 1)
    tops = [max(out[i][0].values(), default=-1) if i <= clean else -1 for i in range(attempts)]
    back = [leg_by_hand(legs[1], base, i, i == attempts - 1, tops[i] if tops[i] >= 0 else None) for i in range(attempts)]
    done = next((i for i, (_, bad) in enumerate(back) if not bad), attempts - 1)
    failures = sum(bad for _, bad in out[: clean + 1]) + sum(bad for _, bad in back[: done + 1])
    used = {t["trip_id"]: 0 if t["fixed_hour"] >= 0 else 1 + (clean if t["outbound"] else done) for t in trips}
    return {t: (hour, used[t], failures) for t, hour in (out[clean][0] | back[done][0]).items()}


@pytest.mark.parametrize("seed", [17, 582, 994])
@pytest.mark.parametrize("attempts", [1, 3, 100])
def test_chains(spark, seed, attempts):
    rng_ = np.random.default_rng(seed)
    rows = []
    for tour in range(60):
        for outbound in (True, False) if tour % 7 else (tour % 2 == 0,):
            n = int(rng_.integers(1, 6))
            for k in range(n):
                p = rng_.random(19) * (rng_.random(19) > 0.3)
                p[3:9] = 0
                p = p / p.sum() * (0.9 if tour % 5 else 0.2)
                fixed = int(rng_.integers(6, 20)) if rng_.random() < 0.1 else -1
                low, high = (5, 23) if tour % 3 else (9, int(rng_.integers(9, 14)))
                rows.append((tour // 2, tour, tour * 100 + outbound * 50 + k, outbound, k + 1, n, low, high, fixed, p.tolist(), rng_.random(attempts).tolist()))
    schema = "person_id long, tour_id long, trip_id long, outbound boolean, trip_num int, trip_count int, low int, high int, fixed_hour int, probs array<double>, draws array<double>"
    df = spark.createDataFrame(rows, schema)
    got = {r.trip_id: (r.depart, r.draws_used, r.failures) for r in chains.schedule_chains(df.repartition(3), 5, attempts).collect()}
    names_ = [x.split()[0] for x in schema.split(", ")]
    want = {}
    for tour in range(60):
        want |= tour_by_hand([dict(zip(names_, r, strict=True)) for r in rows if r[1] == tour], 5, attempts)
    assert got == want and sum(f > 0 for _, _, f in want.values()) > 20
    assert chains.schedule_chains(df.limit(0), 5, attempts).count() == 0
    one = df.where("outbound and fixed_hour < 0").select("tour_id", "trip_id", "trip_num", "low", "high", F.col("probs"), F.col("draws")[0].alias("draw"))
    assert chains.forward_leg(one, 5).count() == one.count()
    timed = chains.clipped_departures(one, "probs", 19, 5, F.col("low"), F.col("high"), F.col("draw"), F.col("trip_num") == 1, "hour")
    held = dict(zip(names_, zip(*rows, strict=True), strict=True))
    by_trip = {t: dict(zip(names_, r, strict=True)) for t, r in zip(held["trip_id"], rows, strict=True)}
    for r in timed.select("trip_id", "hour").collect():
        t = by_trip[r.trip_id]
        assert (hour_by_hand(t, 5, t["low"], t["high"], 0, t["trip_num"] == 1) or -1) == r.hour


def test_trip_numbers(spark):
    legs = spark.createDataFrame([(1, 7), (1, 5), (2, 9)], "tour_id long, trip_id long")
    held = chains.contiguous(chains.numbered(legs, ["tour_id"]), ["tour_id"])
    assert sorted((r.trip_id, r.trip_num, r.trip_count) for r in held.collect()) == [(5, 1, 2), (7, 2, 2), (9, 1, 1)]
    with pytest.raises(Exception, match="not contiguous"):
        chains.contiguous(chains.numbered(legs, ["tour_id"]).where("trip_id <> 5"), ["tour_id"]).collect()
    down = chains.cumulative_count(legs, ["tour_id"], "trip_id", "after", False)
    assert {r.trip_id: r.after for r in down.collect()} == {5: 1, 7: 0, 9: 0}


def test_draws(spark):
    odd = [-1, -(1 << 63), (1 << 63) - 1, 1 << 40, 0]
    ids_ = spark.createDataFrame([(i,) for i in odd], "id long").select("id", rng.entity_uniform(F.col("id"), 1 << 35, 9).alias("u")).collect()
    assert [np.float32({r.id: r.u for r in ids_}[i]) for i in odd] == rng.counter_uniforms(np.array(odd), 1 << 35, 9).tolist()
    ids = spark.range(100).repartition(7)
    got = {r.id: r.u for r in ids.select("id", rng.entity_uniform(F.col("id"), 7, 3).alias("u")).collect()}
    assert [np.float32(got[i]) for i in range(100)] == rng.counter_uniforms(np.arange(100), 7, 3).tolist() and max(got.values()) < 1
    ledger = rng.Ledger.start(spark.range(3).withColumnRenamed("id", "e"), "e", 5, "persons", "step")
    seeds = {r.e: r.seed for r in ledger.rows.collect()}
    first, later = ledger.reserve(2)
    only, last = later.reserve(1, spark.createDataFrame([(1,)], "e long"))
    want = np.random.RandomState(seeds[1]).random_sample(3)
    assert {r.e: r.draws for r in first.collect()}[1] == want[:2].tolist() and only.first().draws == want[2:].tolist()
    assert {r.e: r.rng_offset for r in last.rows.collect()} == {0: 2, 1: 3, 2: 2}
    state = np.random.RandomState(9)
    state.random_sample(4)
    normals = spark.range(1).select(rng.seeded_normals(F.lit(9), F.lit(4), 3)).first()[0]
    assert normals == state.standard_normal(3).tolist()


def test_gathers_go_by_leases(spark):
    graph = Graph(spark)
    graph.ingress("zones", spark.createDataFrame([(1, 5.0), (2, 6.0)], "zone int, jobs double"))
    lease = graph.lease("zones")
    trips = spark.createDataFrame([(1,), (2,), (2,)], "zone int")
    assert sorted(r.jobs for r in graph.gather(lease, trips, ["zone"], ["jobs"]).collect()) == [5.0, 6.0, 6.0]
    with pytest.raises(ValueError, match="no columns"):
        graph.gather(lease, trips, ["zone"], ["homes"])
    with pytest.raises(Exception, match="missing"):
        graph.gather(lease, spark.createDataFrame([(3,)], "zone int"), ["zone"], ["jobs"]).collect()
    graph.run("more", ["zones"], ["zones"], lambda held: {"zones": held["zones"].withColumn("jobs", F.col("jobs") + 1)})
    with pytest.raises(ValueError, match="since it was leased"):
        graph.gather(lease, trips, ["zone"], ["jobs"])
    lease = graph.lease("zones")
    graph.invalidate("zones")
    with pytest.raises(ValueError, match="since it was leased"):
        graph.gather(lease, trips, ["zone"], ["jobs"])
    with pytest.raises(ValueError, match="no stage has written"):
        graph.run("again", ["zones"], ["zones"], dict)


def test_compiled_sums_are_those_of_numpy(spark):
    rng = np.random.default_rng(15)
    lengths = [0, 1, 2, 7, 8, 9, 15, 16, 17, 64, 127, 128, 129, 136, 200, 255, 256, 257, 300]
    for part in (lengths[:10], lengths[10:14], lengths[14:]):
        arrays = [(rng.normal(size=n) * 10.0 ** rng.integers(-3, 4, n)).astype(np.float32) for n in part for _ in range(5)]
        rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(arrays)], "i int, x array<float>")
        got = {r.i: r.s for r in rows.select("i", aggregates.pairwise_columns("x", part).alias("s")).collect()}
        assert all(np.float32(got[i]) == x.sum() for i, x in enumerate(arrays))
    with pytest.raises(Exception, match="no sum of"):
        rows.select(aggregates.pairwise_columns("x", [5])).collect()


def test_aggregates(spark):
    df = spark.createDataFrame([(1, 1, 1e16), (1, 2, 1.0), (1, 3, -1e16), (2, 1, 5.0)], "g int, o int, v double")
    assert {r.g: r.v for r in aggregates.ordered_sum(df.repartition(3), "g", "o", "v").collect()} == {1: 0.0, 2: 5.0}
    texts = spark.createDataFrame([(str(i * 7919 % 1000), i) for i in range(3000)] + [(None, -1)], "v string, i int")
    coded = {r.v: r.code for r in aggregates.codes(texts, "v", "code", 8).collect()}
    assert coded == {None: None} | {v: i for i, v in enumerate(sorted({str(i) for i in range(1000)}))}
    parts = aggregates.in_ranges(spark.range(5), "id", 2).collect()
    assert [(r.id, r.part) for r in sorted(parts)] == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]
    with pytest.raises(Exception, match="varies"):
        aggregates.stable(df, "g", ["v"]).collect()
    arrays = [np.random.default_rng(i).random(n).astype(np.float32) for i, n in enumerate((1000, 0, 7, 1000, 129, 5000))]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(arrays)], "i int, x array<float>")
    sums = {r.i: r.s for r in rows.select("i", aggregates.pairwise_sum(F.col("x")).alias("s")).collect()}
    assert all(sums[i] == x.sum() for i, x in enumerate(arrays))
    other = df.withColumn("v", F.when(F.col("o") == 2, 1.00001).otherwise(F.col("v")))
    assert aggregates.compare_outputs(df, other, ["g", "o"], {"v": 1e-4}).count() == 0
    assert [(r.o, r.column) for r in aggregates.compare_outputs(df, other, ["g", "o"], {}).collect()] == [(2, "v")]


def test_availability(spark):
    row = {"i_tour_mode": 13, "auto_ownership": 1, "outbound": True} | {f"{k}_{s}": 1 for k in ("WLK", "DRV", "BRV") for s in inputs.TRANSIT}
    got = inputs.trip_availability(spark.createDataFrame([row])).first()
    assert got.walk_com_available and not got.drive_loc_available
    times = dict.fromkeys(inputs.tour_availability_columns(), 100.0) | {"auto_ownership": 0}
    got = inputs.tour_availability(spark.createDataFrame([times | {"in_SOV_TIME": 0.0, "in_SOVTOLL_VTOLL": 0.0, "in_HOV2_TIME": 0.0, "in_WLK_EXP_WLK_KEYIVT": 0.0}])).first()
    assert not got.sov_available and got.sovtoll_available and got.hov2_available and got.walk_express_available and not got.drive_local_available
    none = {"auto_ownership": 1, "out_WLK_LRF_WLK_FERRYIVT": 0.0, "in_WLK_LRF_WLK_FERRYIVT": 0.0, "in_WLK_LRF_DRV_KEYIVT": 0.0, "out_DRV_LRF_WLK_KEYIVT": 0.0}
    got = inputs.tour_availability(spark.createDataFrame([times | none])).first()
    assert got.walk_lrf_available and not got.walk_ferry_available and not got.drive_lrf_available and got.drive_local_available
    assert sum(c.endswith("_available") for c in got.asDict()) == 18


def test_artifacts_matrices_and_stages(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3.0), (1, 2, 1.0), (2, 1, 5.0)], "orig int, dest int, trips double")
    write_artifact(df, str(tmp_path / "a"), {"k": 1})
    assert read_artifact(spark, str(tmp_path / "a"), ["orig"]).columns == ["orig"]
    with pytest.raises(Exception):
        write_artifact(df, str(tmp_path / "a"))
    spark.createDataFrame([(9, 9, 9.0)], df.schema).write.mode("append").parquet(str(tmp_path / "a/data"))
    with pytest.raises(ValueError, match="manifest"):
        read_artifact(spark, str(tmp_path / "a"))
    write_matrices(df.withColumn("w", F.lit(2.0)), {"all": ["trips"], "twice": ["trips", "trips"]}, str(tmp_path / "m"), "w")
    cells = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.matrix, r.orig): r.value for r in cells.collect()} == {("all", 1): 2.0, ("all", 2): 2.5, ("twice", 1): 4.0, ("twice", 2): 5.0}
    assert {r.orig: (r["1"], r["2"]) for r in dense_matrix(cells.where("matrix = 'all'"), [1, 2]).collect()} == {1: (0.0, 2.0), 2: (2.5, 0.0)}
    write_cube(df.withColumn("cost", F.col("trips") * 2), str(tmp_path / "cube"), ["trips", "cost"])
    assert read_cube(spark, str(tmp_path / "cube"), ["cost"]).columns == ["orig", "dest", "cost"]
    changed = spark.createDataFrame([(9, 9, 1.0, 0.0)], "orig int, dest int, trips double, cost double")
    changed.write.mode("append").parquet(str(tmp_path / "cube/data"))
    with pytest.raises(ValueError, match="manifest"):
        read_cube(spark, str(tmp_path / "cube"), ["trips"])
    graph = Graph(spark)
    graph.ingress("t", df)
    graph.seal()
    lease = graph.lease("t")
    graph.run("s", ["t"], ["t"], lambda held: {"t": held["t"].where("orig = 1")})
    with pytest.raises(ValueError, match="changed"):
        graph.read(lease)
    with pytest.raises(ValueError, match="declared"):
        graph.run("s", ["t"], ["u"], lambda held: {})
    graph.checkpoint(str(tmp_path / "c"), ["t"])
    again = Graph(spark)
    again.restore(str(tmp_path / "c"), ["t"])
    assert again.tables["t"].count() == 2 and again.versions["t"] == 2


def test_streaming_extension(spark, tmp_path):
    from wayfare.streaming.bookings import booked

    rows = spark.createDataFrame([(1, 1, 8, 10), (1, 2, 9, 12), (2, 3, 9, 12), (1, 4, 11, 12)], "person_id long, tour_id long, start int, end int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = booked(stream).writeStream.format("memory").queryName("booked").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.tour_id: r.accepted for r in spark.table("booked").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_catalogue_without_the_corpus_folder():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and "mnl_choice" in entry.queries()
