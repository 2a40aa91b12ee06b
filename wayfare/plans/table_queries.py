"""Registered queries: expressions, lookups, timetables, tours, chains and matrices, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.functions import ieee
from wayfare.functions.expressions import Compiler
from wayfare.operators import aggregates, chains, choice, inputs, lookup, scheduling, timetable, tours
from wayfare.plans.choice_queries import _LINES, CHOOSE, draw, draw_sql, lines, rounded, table
from wayfare.plans.session import kept
from wayfare.sources.tables import matrix_cells

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


EXPRESSIONS = {
    "scaled": "(l_extendedprice / 1000 - 2).clip(0, upper=40)",
    "ratio": "l_quantity / (l_linenumber - 1)",
    "flag": "(l_discount > 0.04) & ~(l_tax >= 0.06) | (l_linenumber == 7)",
    "chained": "1 < l_linenumber <= 4",
    "largest": "np.maximum(df.l_quantity * 2, l_extendedprice / 900)",
    "chosen": "np.where(l_returnflag == 'R', -l_quantity, np.log1p(l_quantity))",
    "mixed": "(l_linenumber > 2 and l_quantity < 30) * 3 + (not (l_quantity < 10))",
}


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(least(l_extendedprice / 1000 - 2, 40), 0), 6) + 0.0 AS scaled,
    CASE WHEN l_linenumber = 1 THEN -1.0 ELSE round(l_quantity / (l_linenumber - 1), 6) END AS ratio,
    ((l_discount > 0.04 AND NOT l_tax >= 0.06) OR l_linenumber = 7)::INT AS flag, (1 < l_linenumber AND l_linenumber <= 4)::INT AS chained,
    round(greatest(l_quantity * 2, l_extendedprice / 900), 6) AS largest, round(CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE ln(1 + l_quantity) END, 6) AS chosen,
    (l_linenumber > 2 AND l_quantity < 30)::INT * 3.0::DOUBLE + (NOT l_quantity < 10)::INT AS mixed FROM lineitem"""
)
def expression_features(spark: SparkSession, folder: str) -> DataFrame:
    """The expression grammar compiled to columns (E1-E9, E13, E17); infinities are shown as -1."""
    rows = table(spark, folder, "lineitem")
    compiler = Compiler({c: F.col(c) for c in rows.columns})
    values = {k: compiler.number(e) for k, e in EXPRESSIONS.items()}
    values["ratio"] = F.when(ieee.finite(values["ratio"]), values["ratio"]).otherwise(-1.0)
    whole = {"flag": "int", "chained": "int"}
    out = [values[k].cast(whole[k]).alias(k) if k in whole else rounded(values[k]).alias(k) for k in EXPRESSIONS]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *out)


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(((((0::FLOAT + l_quantity::FLOAT * 0.1::FLOAT) + l_discount::FLOAT * (-2.5)::FLOAT) + l_tax::FLOAT * 3.0::FLOAT) + (l_extendedprice / 1000)::FLOAT * 0.01::FLOAT)::DOUBLE, 5) + 0.0 AS utility FROM lineitem"""
)
def strict_utility(spark: SparkSession, folder: str) -> DataFrame:
    """Source-ordered single-precision utility."""
    rows = table(spark, folder, "lineitem")
    terms = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_extendedprice") / 1000]
    value = choice.ordered_float_utility(terms, [0.1, -2.5, 3.0, 0.01])
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", rounded(value.cast("double"), 5).alias("utility"))


@query(
    """SELECT p_brand, n_name, CAST(count(*) AS BIGINT) AS rows, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
    JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2"""
)
def keyed_gather(spark: SparkSession, folder: str) -> DataFrame:
    """Lines take attributes of their part and supplier by key, strictly (J1-J3, J7), then sums."""
    rows = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey"), "l_quantity")
    held = lookup.gather(rows, table(spark, folder, "part"), ["p_partkey"], ["p_brand"])
    suppliers = lookup.gather(
        table(spark, folder, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), table(spark, folder, "nation"), ["n_nationkey"], ["n_name"]
    )
    held = lookup.gather(held, suppliers, ["s_suppkey"], ["n_name"])
    return held.groupBy("p_brand", "n_name").agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query(
    """SELECT o_orderkey, o_custkey, o_orderstatus, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 5) AS net, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey"""
)
def interaction_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Alternatives joined with their chooser."""
    alternatives = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    joined = lookup.interaction(alternatives, table(spark, folder, "orders"), "o_orderkey")
    net = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 5)
    return joined.select("o_orderkey", "o_custkey", "o_orderstatus", "l_linenumber", "l_partkey", net.alias("net"), "o_totalprice")


@query(
    """SELECT o_custkey AS id, CAST(sum(n) OVER (ORDER BY o_custkey ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first, n AS count FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)"""
)
def ragged_offsets(spark: SparkSession, folder: str) -> DataFrame:
    """Where each chooser's rows begin when sorted, without one task that sees all choosers."""
    rows = table(spark, folder, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey")
    return lookup.offsets(rows, "id", "o_orderkey")


@query(
    """WITH s AS (SELECT o_custkey AS id, CAST(o_orderkey % 25 AS INTEGER) AS slot, max(o_custkey * 100 + o_orderkey % 25) / 7.0::DOUBLE AS v FROM orders GROUP BY 1, 2)
    SELECT id, CAST(count(*) AS BIGINT) AS filled, round(sum(v), 4) AS total FROM s GROUP BY 1"""
)
def logsum_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Values by slot for each owner, checked to agree."""
    key = F.col("o_custkey")
    rows = table(spark, folder, "orders").select(
        key.alias("id"), (F.col("o_orderkey") % 25).cast("int").alias("slot"), ((key * 100 + F.col("o_orderkey") % 25) / 7.0).alias("v")
    )
    held = lookup.scattered(rows, "id", "slot", "v")
    solid = F.filter("slots", lambda v: v.isNotNull())
    return held.select("id", F.size(solid).cast("long").alias("filled"), F.round(F.aggregate(solid, F.lit(0.0), lambda a, v: a + v), 4).alias("total"))


_TDD = """
tdd AS (SELECT CAST(row_number() OVER (ORDER BY s, e) - 1 AS INTEGER) AS tdd, s, e FROM (SELECT unnest(range(5, 24)) AS s), (SELECT unnest(range(5, 24)) AS e) WHERE s <= e),
cell AS (SELECT tdd, s, e, unnest(range(s, e + 1)) AS p FROM tdd),
state AS (SELECT tdd, s, e, p, CASE WHEN s = e THEN 6 WHEN p = s THEN 2 WHEN p = e THEN 4 ELSE 7 END AS st FROM cell),
win AS (SELECT o_custkey AS id, p, bit_or(st) AS w FROM orders JOIN state ON tdd = o_orderkey % 190 WHERE o_orderstatus = 'O' GROUP BY 1, 2),
who AS (SELECT DISTINCT id FROM win),
bad AS (SELECT DISTINCT id, tdd FROM win JOIN state USING (p) WHERE (st = 2 AND w IN (2, 7)) OR (st = 4 AND w IN (4, 7)) OR (st = 7) OR (st = 6 AND w = 7)),
ok AS (SELECT who.id, tdd.tdd, s, e FROM who CROSS JOIN tdd WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.id = who.id AND bad.tdd = tdd.tdd))
"""
_PERIOD = "CASE WHEN {x} <= 5 THEN 0 WHEN {x} <= 9 THEN 1 WHEN {x} <= 14 THEN 2 WHEN {x} <= 18 THEN 3 ELSE 4 END"


def timetabled(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, timetable.Footprints]:
    prints = timetable.hourly()
    alternatives = prints.table(spark)
    tours_ = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("person_id"), (F.col("o_orderkey") % 190).cast("int").alias("tdd"))
    return timetable.windows(tours_, alternatives), alternatives, prints


@query(
    f"WITH {_TDD} SELECT id AS person_id, CAST({_PERIOD.format(x='s')} * 5 + {_PERIOD.format(x='e')} AS INTEGER) AS slot, min(tdd) AS first_tdd, CAST(count(*) AS INTEGER) AS feasible FROM ok GROUP BY 1, 2"
)
def feasible_tours(spark: SparkSession, folder: str) -> DataFrame:
    """Tours that fit each person's timetable, the first and the number by pair of periods."""
    windows, alternatives, _ = timetabled(spark, folder)
    return timetable.first_by_slot(timetable.feasible(windows, alternatives), "person_id")


@query(
    f"""WITH {_TDD}, mid AS (SELECT id, count(*) AS m FROM win WHERE w = 7 GROUP BY 1)
    SELECT ok.id AS person_id, tdd, coalesce(a.w IN (4, 6), false) AS previous_ends, coalesce(b.w IN (2, 6), false) AS previous_begins, s > 5 AND coalesce(c.w, 0) <> 7 AS adjacent_before, e < 23 AND coalesce(d.w, 0) <> 7 AS adjacent_after,
        CAST(19 - coalesce(m, 0) - greatest(e - s - 1, 0) AS INTEGER) AS remaining
    FROM ok LEFT JOIN win a ON a.id = ok.id AND a.p = s LEFT JOIN win b ON b.id = ok.id AND b.p = e LEFT JOIN win c ON c.id = ok.id AND c.p = s - 1 LEFT JOIN win d ON d.id = ok.id AND d.p = e + 1 LEFT JOIN mid ON mid.id = ok.id"""
)
def scheduling_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Feasible tours with what utilities ask of the timetable."""
    windows, alternatives, prints = timetabled(spark, folder)
    rows = timetable.vocabulary(timetable.feasible(windows, alternatives), prints.first, prints.width)
    return rows.select("person_id", "tdd", "previous_ends", "previous_begins", "adjacent_before", "adjacent_after", F.col("remaining").cast("int").alias("remaining"))


def _tour_sql(kind: int, number: int, place: int, when: str, position: str) -> str:
    return f"SELECT person_id * 41 + {place} AS tour_id, person_id, {kind} AS tour_type, {number} AS tour_type_num, CASE WHEN c = 4 AND NOT worker THEN 3 - ({position}) ELSE {position} END AS tour_num, wc + sc AS tour_count, {'work' if kind == 0 else 'school'} AS destination FROM n WHERE {when}"


@query(
    """WITH p AS (SELECT c_custkey AS person_id, c_custkey % 5 AS c, c_acctbal > 2000 AS worker, 100 + c_nationkey AS work, 200 + c_nationkey AS school FROM customer),
    n AS (SELECT *, CASE WHEN c = 1 THEN 2 WHEN c IN (0, 4) THEN 1 ELSE 0 END AS wc, CASE WHEN c = 3 THEN 2 WHEN c IN (2, 4) THEN 1 ELSE 0 END AS sc FROM p) """
    + " UNION ALL ".join(
        [
            _tour_sql(0, 1, 39, "wc >= 1", "1"),
            _tour_sql(0, 2, 40, "wc >= 2", "2"),
            _tour_sql(1, 1, 31, "sc >= 1", "wc + 1"),
            _tour_sql(1, 2, 32, "sc >= 2", "wc + 2"),
        ]
    )
)
def mandatory_tours(spark: SparkSession, folder: str) -> DataFrame:
    """One or two tours for each person."""
    return persons_with_tours(spark, folder).select("tour_id", "person_id", "tour_type", "tour_type_num", "tour_num", "tour_count", "destination")


def persons_with_tours(spark: SparkSession, folder: str) -> DataFrame:
    zone = F.col("c_nationkey")
    persons = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("person_id"), zone.alias("household_id"), (F.col("c_custkey") % 5).cast("int").alias("mtf_choice"), (F.col("c_acctbal") > 2000).alias("is_worker"),
        (zone + 100).alias("workplace_zone_id"), (zone + 200).alias("school_zone_id"), zone.alias("home_zone_id"),
    )
    return tours.mandatory(persons)


def _batch_sql(number: int, extra: str, join: str) -> str:
    names = CHOOSE.replace("chosen AS", f"chosen{number} AS")
    for x in ("w", "c", "t"):
        names = names.replace(f"\n{x} AS", f"\n{x}{number} AS").replace(f"FROM {x}\n", f"FROM {x}{number}\n").replace(f"FROM {x})", f"FROM {x}{number})").replace(f"FROM {x} GROUP", f"FROM {x}{number} GROUP")
    names = names.replace("FROM u)", f"FROM u{number})")
    return f"""u{number} AS (SELECT tour_id AS id, tdd.tdd AS alt, -0.1::DOUBLE * abs(s - 8) - 0.05::DOUBLE * abs(e - 17) + 0.02::DOUBLE * (e - s){extra} AS util, {draw_sql("tour_id", 13)} AS z
        FROM tours CROSS JOIN tdd {join} WHERE tour_num = {number}{" AND bad.tdd IS NULL" if number > 1 else ""}), {names}"""


_TOURS = (
    """p AS (SELECT c_custkey AS person_id, c_custkey % 5 AS c, c_acctbal > 2000 AS worker, 100 + c_nationkey AS work, 200 + c_nationkey AS school FROM customer),
    n AS (SELECT *, CASE WHEN c = 1 THEN 2 WHEN c IN (0, 4) THEN 1 ELSE 0 END AS wc, CASE WHEN c = 3 THEN 2 WHEN c IN (2, 4) THEN 1 ELSE 0 END AS sc FROM p),
    tours AS ("""
    + " UNION ALL ".join(
        [_tour_sql(0, 1, 39, "wc >= 1", "1"), _tour_sql(0, 2, 40, "wc >= 2", "2"), _tour_sql(1, 1, 31, "sc >= 1", "wc + 1"), _tour_sql(1, 2, 32, "sc >= 2", "wc + 2")]
    )
    + ")"
)
_CELLS = _TDD[: _TDD.index("win AS")].rstrip().rstrip(",")


@query(
    f"""WITH {_CELLS}, {_TOURS}, {_batch_sql(1, "", "")},
    win AS (SELECT person_id, p, st AS w FROM chosen1 JOIN tours ON tours.tour_id = chosen1.id JOIN state ON state.tdd = choice),
    bad AS (SELECT DISTINCT person_id AS pid, tdd FROM win JOIN state USING (p) WHERE (st = 2 AND w IN (2, 7)) OR (st = 4 AND w IN (4, 7)) OR (st = 7) OR (st = 6 AND w = 7)),
    {_batch_sql(2, " + CASE WHEN a.w IN (4, 6) THEN 0.5::DOUBLE ELSE 0 END", "LEFT JOIN bad ON bad.pid = tours.person_id AND bad.tdd = tdd.tdd LEFT JOIN win a ON a.person_id = tours.person_id AND a.p = s")}
    SELECT id AS tour_id, choice AS tdd, logsum FROM chosen1 UNION ALL SELECT id, choice, logsum FROM chosen2"""
)
def tour_schedule(spark: SparkSession, folder: str) -> DataFrame:
    """Tours of all persons scheduled in two batches, the second around the first."""
    held = persons_with_tours(spark, folder).select("person_id", "tour_id", "tour_num", draw(F.col("tour_id"), 13).alias("z"))

    def utility(rows: DataFrame) -> DataFrame:
        base = F.abs(F.col("start") - 8) * -0.1 - F.abs(F.col("end") - 17) * 0.05 + F.col("duration") * 0.02
        return rows.withColumn("utility", base + F.when(F.col("previous_ends"), 0.5).otherwise(0.0))

    done = scheduling.schedule_batches(held, timetable.hourly(), utility, [1, 2], kept)
    return done.select("tour_id", "tdd", rounded(F.col("logsum")).alias("logsum"))


PERIODS = 19


def hour_probs(key):
    """A departure distribution by key: weights 1 + (key + 3 i) mod 5, made to add up to 0.95."""
    weights = F.transform(F.sequence(F.lit(0), F.lit(PERIODS - 1)), lambda i: (1 + (key + i * 3) % 5).cast("double"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return choice.let(total, lambda t: F.transform(weights, lambda x: x / t * 0.95))


@query(
    f"""WITH h AS (SELECT unnest(range({PERIODS})) AS i),
    k AS (SELECT o_orderkey AS id, {draw_sql("o_orderkey", 11)} AS z, o_orderkey % 9 AS lo, 9 + o_custkey % 10 AS hi, o_orderkey % 2 = 0 AS norm FROM orders),
    q AS (SELECT id, z, lo, hi, norm, i, (1 + (id + i * 3) % 5)::DOUBLE / sum((1 + (id + i * 3) % 5)::DOUBLE) OVER (PARTITION BY id) * 0.95 AS p FROM k, h),
    c AS (SELECT *, CASE WHEN i BETWEEN lo AND hi THEN p ELSE 0 END AS kept FROM q),
    t AS (SELECT *, sum(kept) OVER (PARTITION BY id) AS total FROM c),
    u AS (SELECT *, sum(CASE WHEN norm THEN kept / total ELSE kept END) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM t)
    SELECT id AS o_orderkey, CAST(coalesce(min(CASE WHEN z - upto <= 0 THEN i END) + 5, -1) AS INTEGER) AS depart FROM u GROUP BY id"""
)
def departures(spark: SparkSession, folder: str) -> DataFrame:
    """Departure hours within bounds, with failure as an outcome."""
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", draw(key, 11).alias("z"), (key % 9 + 5).alias("low"), (F.col("o_custkey") % 10 + 14).alias("high"), (key % 2 == 0).alias("norm"), hour_probs(key).alias("p")
    )
    held = chains.clipped_departures(rows, "p", PERIODS, 5, F.col("low"), F.col("high"), F.col("z"), F.col("norm"))
    return held.select("o_orderkey", "depart")


#: Parts of SQL for chains: hours from 1, bounds ``lo`` and ``hi``, a draw ``z``; an hour beyond ``hi`` is a failure.
_HOURS = f"""
    w AS (SELECT *, list_transform(range({PERIODS}), lambda i: (1 + (trip + i * 3) % 5)::DOUBLE) AS ws FROM trips),
    tr AS (SELECT * EXCLUDE ws, list_prepend(0.0::DOUBLE, list_transform(range(1, {PERIODS + 1}), lambda i: list_sum(ws[1:i]) / list_sum(ws) * 0.95)) AS s FROM w)"""
#: ``s`` has a zero before the sums, so that ``s[h]`` is what comes before hour h.
_HIT = "lo + len(list_filter(s[lo + 1:hi + 1], lambda x: x - s[lo] < z * (CASE WHEN norm THEN s[hi + 1] - s[lo] ELSE 1 END)))"


@query(
    f"""WITH RECURSIVE {_LINES}, trips AS (SELECT id AS tour, id * 64 + alt + 1 AS trip, alt + 1 AS n, {draw_sql("(id * 64 + alt + 1)", 12)} AS z FROM l), {_HOURS},
    c AS (SELECT tour, 0::BIGINT AS n, 1::BIGINT AS bound FROM (SELECT DISTINCT tour FROM tr) UNION ALL
        SELECT tour, n, CASE WHEN hit > hi THEN lo ELSE hit END FROM (SELECT *, {_HIT} AS hit FROM (SELECT c.tour, tr.n, bound AS lo, {PERIODS} AS hi, s, z, tr.n = 1 AS norm FROM c JOIN tr ON tr.tour = c.tour AND tr.n = c.n + 1)))
    SELECT tour AS tour_id, trip AS trip_id, CAST(bound + 4 AS INTEGER) AS depart FROM c JOIN tr USING (tour, n)"""
)
def outbound_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Outbound trips of every order, each no earlier than the one before, with numbers that are checked."""
    rows = lines(spark, folder).select(F.col("l_orderkey").alias("tour_id"), (F.col("alt_pos") + 1).alias("trip_num"))
    rows = chains.contiguous(rows.select("tour_id", "trip_num", (F.col("tour_id") * 64 + F.col("trip_num")).alias("trip_id")), ["tour_id"])
    rows = rows.select("*", F.lit(5).alias("low"), F.lit(23).alias("high"), hour_probs(F.col("trip_id")).alias("probs"), draw(F.col("trip_id"), 12).alias("draw"))
    return chains.forward_leg(rows, 5)


ATTEMPTS = 5


@query(
    f"""WITH RECURSIVE {_LINES}, trips AS (SELECT id AS tour, id * 64 + alt + 1 AS trip, alt % 2 = 0 AS outbound, alt // 2 + 1 AS n FROM l), {_HOURS},
    v AS (SELECT tour, outbound, unnest(range({ATTEMPTS})) AS a, max(n) AS size FROM tr GROUP BY tour, outbound),
    o AS (SELECT tour, a, 0::BIGINT AS n, 4::BIGINT AS bound, -1::BIGINT AS hour, 0 AS failed FROM v WHERE outbound UNION ALL
        SELECT tour, a, n, CASE WHEN hit > hi THEN lo ELSE hit END, CASE WHEN hit <= hi THEN hit WHEN a = {ATTEMPTS - 1} THEN lo ELSE -1 END, failed + (hit > hi)::INT
        FROM (SELECT *, {_HIT} AS hit FROM (SELECT o.tour, a, tr.n, bound AS lo, 16 AS hi, s, {draw_sql("trip", 20).replace(f"{20 * 40503}", "(20 + a) * 40503")} AS z, tr.n = 1 AS norm, failed FROM o JOIN tr ON tr.tour = o.tour AND tr.n = o.n + 1 AND outbound))),
    oa AS (SELECT tour, a, max(hour) AS top, max(failed) AS failed FROM o GROUP BY tour, a),
    og AS (SELECT tour, coalesce(min(CASE WHEN failed = 0 THEN a END), {ATTEMPTS - 1}) AS done FROM oa GROUP BY tour),
    i AS (SELECT v.tour, v.a, size + 1 AS n, 16::BIGINT AS bound, -1::BIGINT AS hour, 0 AS failed, CASE WHEN v.a <= og.done AND top >= 0 THEN top ELSE 4 END AS lo, size
        FROM v JOIN og ON og.tour = v.tour JOIN oa ON oa.tour = v.tour AND oa.a = v.a WHERE NOT outbound UNION ALL
        SELECT tour, a, n, CASE WHEN hit > hi THEN hi ELSE hit END, CASE WHEN hit <= hi THEN hit WHEN a = {ATTEMPTS - 1} THEN hi ELSE -1 END, failed + (hit > hi)::INT, lo, size
        FROM (SELECT *, CASE WHEN lo > hi THEN hi + 1 ELSE {_HIT} END AS hit FROM (SELECT i.tour, a, tr.n, lo, bound AS hi, s, {draw_sql("trip", 20).replace(f"{20 * 40503}", "(20 + a) * 40503")} AS z, tr.n = size AS norm, failed, size FROM i JOIN tr ON tr.tour = i.tour AND tr.n = i.n - 1 AND NOT outbound))),
    ia AS (SELECT tour, a, max(failed) AS failed FROM i GROUP BY tour, a),
    ig AS (SELECT tour, coalesce(min(CASE WHEN failed = 0 THEN a END), {ATTEMPTS - 1}) AS done FROM ia GROUP BY tour),
    f AS (SELECT tour, sum(failed)::INTEGER AS failures FROM (SELECT tour, failed FROM oa JOIN og USING (tour) WHERE a <= done UNION ALL SELECT tour, failed FROM ia JOIN ig USING (tour) WHERE a <= done) GROUP BY tour)
    SELECT tour AS person_id, tour AS tour_id, trip AS trip_id, outbound, CAST(hour + 4 AS INTEGER) AS depart, CAST(done + 1 AS INTEGER) AS draws_used, failures
    FROM (SELECT o.*, done, true AS outbound FROM o JOIN og ON og.tour = o.tour AND a = done UNION ALL SELECT i.* EXCLUDE (lo, size), done, false FROM i JOIN ig ON ig.tour = i.tour AND a = done) x
    JOIN tr USING (tour, n, outbound) JOIN f USING (tour)"""
)
def retried_chain(spark: SparkSession, folder: str) -> DataFrame:
    """Both legs of every tour with retries of failed legs."""
    rows = lines(spark, folder).select(F.col("l_orderkey").alias("tour_id"), (F.col("alt_pos") + 1).alias("n"))
    rows = rows.select("tour_id", (F.col("tour_id") * 64 + F.col("n")).alias("trip_id"), (F.col("n") % 2 == 1).alias("outbound"))
    rows = chains.numbered(rows, ["tour_id", "outbound"])
    draws = F.array(*[draw(F.col("trip_id"), 20 + i) for i in range(ATTEMPTS)])
    rows = rows.select(
        F.col("tour_id").alias("person_id"), "tour_id", "trip_id", "outbound", "trip_num", "trip_count", F.lit(8).alias("low"), F.lit(20).alias("high"), F.lit(-1).alias("fixed_hour"),
        hour_probs(F.col("trip_id")).alias("probs"), draws.alias("draws"),
    )
    return chains.schedule_chains(rows, 5, ATTEMPTS)


@query(
    f"""WITH e AS (SELECT user_id, hour(ts) AS h, value FROM events)
    SELECT user_id, CAST({_PERIOD.format(x="h")} AS INTEGER) AS period, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS value FROM e GROUP BY 1, 2"""
)
def period_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the skim period of their hour."""
    rows = table(spark, folder, "events").select("user_id", ieee.period_of(F.hour("ts")).alias("period"), "value")
    return rows.groupBy("user_id", "period").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query(
    """SELECT c_nationkey AS orig, s_nationkey AS dest, round(sum(l_quantity / 10.0), 3) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2 HAVING sum(l_quantity / 10.0) <> 0"""
)
def od_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Trips summed by origin and destination over an expansion weight, empty cells left out."""
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("orig"))
    suppliers = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dest"))
    joined = rows.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    cells = matrix_cells(joined.withColumn("weight", F.lit(10.0)), {"quantity": ["l_quantity"]}, "weight")
    return cells.select("orig", "dest", F.round("value", 3).alias("value"))


_ZONES = """
z AS (SELECT n_nationkey AS zone, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)::DOUBLE * 40 AS pop, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey)::DOUBLE * 60 AS emp, 20.0 + n_nationkey * n_nationkey * 9.0 AS acres FROM nation),
band AS (SELECT zone, CASE WHEN d <= 500 THEN 5 WHEN d <= 2000 THEN 4 WHEN d <= 5000 THEN 3 WHEN d <= 15000 THEN 2 ELSE 1 END AS band FROM (SELECT zone, (pop + emp) / (acres / 640) AS d FROM z))
"""
MEANS = {1: 3.0, 2: 5.0, 3: 6.0, 4: 8.0, 5: 12.0}


@query(
    f"""WITH {_ZONES}, b AS (SELECT o_orderkey, (o_orderkey % 7 - 3) / 2.0::DOUBLE AS n, c_nationkey, (o_orderkey % 25)::INTEGER AS dest FROM orders JOIN customer ON c_custkey = o_custkey),
    j AS (SELECT o_orderkey, n, x.band AS ob, y.band AS db FROM b JOIN band x ON x.zone = c_nationkey JOIN band y ON y.zone = dest),
    m AS (SELECT *, CASE ob WHEN 1 THEN 3.0 WHEN 2 THEN 5.0 WHEN 3 THEN 6.0 WHEN 4 THEN 8.0 ELSE 12.0 END::DOUBLE AS om, CASE db WHEN 1 THEN 3.0 WHEN 2 THEN 5.0 WHEN 3 THEN 6.0 WHEN 4 THEN 8.0 ELSE 12.0 END::DOUBLE AS dm FROM j)
    SELECT o_orderkey, CAST(ob AS INTEGER) AS origin_band, CAST(db AS INTEGER) AS destination_band,
    round(least(greatest(exp(ln(om / sqrt(1 + 4.0 / (om * om))) + sqrt(ln(1 + 4.0 / (om * om))) * n), 0), 50) + least(greatest(exp(ln(dm / sqrt(1 + 4.0 / (dm * dm))) + sqrt(ln(1 + 4.0 / (dm * dm))) * -n), 0), 50), 6) AS taxi_wait FROM m"""
)
def ridehail_waits(spark: SparkSession, folder: str) -> DataFrame:
    """Density bands of zones and log-normal waits at both ends of a tour."""
    people = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("zone_id")).agg((F.count(F.lit(1)) * 40.0).alias("TOTPOP"))
    jobs = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("zone_id")).agg((F.count(F.lit(1)) * 60.0).alias("TOTEMP"))
    zones = table(spark, folder, "nation").select(F.col("n_nationkey").alias("zone_id"), (F.lit(20.0) + F.col("n_nationkey") * F.col("n_nationkey") * 9.0).alias("TOTACRE"))
    zones = inputs.banded(zones.join(people, "zone_id", "left").join(jobs, "zone_id", "left").na.fill(0.0)).select("zone_id", "density_band")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("origin"))
    rows = table(spark, folder, "orders").join(customers, "o_custkey").select("o_orderkey", "origin", (F.col("o_orderkey") % 25).cast("int").alias("destination"))
    for end in ("origin", "destination"):
        rows = lookup.gather(rows, zones.select(F.col("zone_id").alias(end), F.col("density_band").alias(f"{end}_band")), [end], [f"{end}_band"])
    n = (F.col("o_orderkey") % 7 - 3) / 2.0
    rows = rows.withColumn("normals", F.array(n, -n, n, n, n, n))
    sds = {k: 2.0 for k in MEANS}
    held = inputs.ridehail_waits(rows, {s: MEANS for s in inputs.SERVICES}, {s: sds for s in inputs.SERVICES})
    return held.select("o_orderkey", F.col("origin_band").cast("int"), F.col("destination_band").cast("int"), F.round("taxi_wait", 6).alias("taxi_wait"))


_TIMES = {s: i for i, s in enumerate(inputs.TRANSIT)}


@query(
    "SELECT o_orderkey, "
    + ", ".join(
        f"((o_orderkey + {i * 3}) % 5 > 0 AND o_custkey % 19 >= {9 + i}) AS walk_{s.lower()}_available, (CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey + {i}) % 4 > 0 ELSE (o_orderkey + {i}) % 3 > 0 END AND o_custkey % 3 > 0 AND o_custkey % 19 >= {14 + i}) AS drive_{s.lower()}_available"
        for s, i in _TIMES.items()
    )
    + " FROM orders"
)
def trip_availability(spark: SparkSession, folder: str) -> DataFrame:
    """Transit availability of trips by times, tour mode, direction and cars."""
    key = F.col("o_orderkey")
    rows = table(spark, folder, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 19).alias("i_tour_mode"), (F.col("o_custkey") % 3).alias("auto_ownership"), (key % 2 == 0).alias("outbound"),
        *[((key + i * 3) % 5).alias(f"WLK_{s}") for s, i in _TIMES.items()], *[((key + i) % 4).alias(f"DRV_{s}") for s, i in _TIMES.items()], *[((key + i) % 3).alias(f"BRV_{s}") for s, i in _TIMES.items()],
    )
    held = inputs.trip_availability(rows)
    return held.select("o_orderkey", *[f"{way}_{s.lower()}_available" for s in inputs.TRANSIT for way in ("walk", "drive")])


@query(
    """SELECT p_partkey, p_size, CASE WHEN p_size <= 10 THEN '5' WHEN p_size <= 20 THEN '15' WHEN p_size <= 40 THEN '30' ELSE '45' END AS bin, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part"""
)
def bins_and_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Bin labels and dense codes."""
    rows = table(spark, folder, "part")
    held = aggregates.codes(rows, "p_brand", "code")
    return held.select("p_partkey", "p_size", aggregates.bin_labels(F.col("p_size"), [0, 10, 20, 40, 50], "mid").alias("bin"), "code")


@query(
    """SELECT c_nationkey AS zone, c_mktsegment AS segment, round(sum(c_acctbal), 2) AS total, min(c_custkey) AS first FROM customer GROUP BY 1, 2"""
)
def segmented_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Sums by segment and each segment's first row, by one partial aggregation."""
    rows = table(spark, folder, "customer").withColumn("group", F.struct(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("segment")))
    found = aggregates.segmented_sum(rows, "group", "c_acctbal", F.min("c_custkey").alias("first"))
    return found.select("group.zone", "group.segment", F.round("c_acctbal", 2).alias("total"), "first")


@query(
    """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 4) AS total FROM lineitem GROUP BY 1"""
)
def ordered_sums(spark: SparkSession, folder: str) -> DataFrame:
    """Each order's few lines summed in a fixed order, so that partitioning changes no bit."""
    rows = lines(spark, folder).select("l_orderkey", "alt_pos", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("total"))
    return aggregates.ordered_sum(rows, "l_orderkey", "alt_pos", "total").withColumn("total", F.round("total", 4))
