"""Registered queries: whole components end to end, each with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfare.operators import choice, nested, sampling, scheduling, skims, timetable, tours
from wayfare.operators.lookup import gather, legs
from wayfare.operators.spec import Spec, utilities
from wayfare.plans.choice_queries import _NESTS, _REGION_U, _SAMPLED, TREE, cube, draw, draw_sql, region_choice, rounded, sampled, table
from wayfare.plans.session import kept
from wayfare.plans.table_queries import _CELLS, _tour_sql

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def choose_sql(tag: str, body: str) -> str:
    """SQL of a choice over rows (id, alt, util, z) of ``body``, as chosen<tag>(id, choice, logsum)."""
    return f"""u{tag} AS ({body}),
    w{tag} AS (SELECT *, max(util) OVER (PARTITION BY id) AS top, exp(util - max(util) OVER (PARTITION BY id)) AS wt FROM u{tag}),
    c{tag} AS (SELECT *, sum(wt) OVER (PARTITION BY id ORDER BY alt ROWS UNBOUNDED PRECEDING) AS upto FROM w{tag}),
    t{tag} AS (SELECT *, max(upto) OVER (PARTITION BY id) AS total FROM c{tag}),
    chosen{tag} AS (SELECT id, CAST(coalesce(min(CASE WHEN upto >= z * total THEN alt END), arg_max(alt, wt)) AS INTEGER) AS choice, round(max(top) + ln(max(total)), 6) + 0.0 AS logsum FROM t{tag} GROUP BY id)"""


#: Modes of a leg: a constant, a distance and a bonus of short ways for those on foot or bicycle.
LEG_SPEC = Spec(
    "leg",
    tuple(f"m{m}" for m in range(21)),
    ("constant", "distance", "near"),
    ("1", "DIST", "(DIST < 10)"),
    (tuple((m % 5 - 2) * 0.2 for m in range(21)), tuple(-(1 + m % 7) / 100 for m in range(21)), tuple(0.5 if m in (6, 7) else 0.0 for m in range(21))),
)
_M = _NESTS[: _NESTS.index("v AS")]


@query(
    f"""WITH {_SAMPLED}, {_M}
    g AS (SELECT s.id, s.alt, 'od' AS direction, c_nationkey AS o, s.alt AS d FROM s JOIN customer ON c_custkey = s.id UNION ALL SELECT s.id, s.alt, 'dp', s.alt, (s.id % 25)::INTEGER FROM s),
    h AS (SELECT g.*, k.dist FROM g JOIN k ON k.orig = g.o AND k.dest = g.d AND k.period = 0),
    v AS (SELECT h.id, h.alt, direction, m.*, (m % 5 - 2) * 0.2::DOUBLE - dist * (1 + m % 7) / 100.0::DOUBLE + CASE WHEN m IN (6, 7) AND dist < 10 THEN 0.5::DOUBLE ELSE 0 END AS util FROM h, m),
    n1 AS (SELECT id, alt, direction, nest, any_value(parent) AS parent, any_value(top) AS top, any_value(sub) * ln(sum(exp(util / scale))) AS s FROM v GROUP BY id, alt, direction, nest),
    n2 AS (SELECT id, alt, direction, parent, any_value(CASE WHEN parent IN (0, 2) THEN top ELSE 1.0 END) * ln(sum(exp(s))) AS s FROM n1 GROUP BY id, alt, direction, parent),
    root AS (SELECT id, alt, direction, ln(sum(exp(s))) AS logsum FROM n2 GROUP BY id, alt, direction),
    legs AS (SELECT id, alt, max(logsum) FILTER (direction = 'od') AS od, max(logsum) FILTER (direction = 'dp') AS dp FROM root GROUP BY id, alt),
    {choose_sql("d", f"SELECT s.id, s.alt, util + 0.3::DOUBLE * od + 0.2::DOUBLE * dp + least(ln(picks / prob), 60) AS util, {draw_sql('s.id', 7)} AS z FROM s JOIN legs ON legs.id = s.id AND legs.alt = s.alt")}
    SELECT id AS c_custkey, choice AS dest, logsum FROM chosend"""
)
def trip_destinations(spark: SparkSession, folder: str) -> DataFrame:
    """Destinations of trips from end to end: a sample, nested mode log-sums of both of its legs from a lowered
    specification, and the choice corrected for sampling (C4, C5, T13, A24-A27, A37-A39).

    Legs of all sampled destinations are one table: matrix values come by one join, and the log-sums of both directions
    by one projection, before they meet again by trip and destination.
    """
    trips = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("trip_id"), F.col("c_nationkey").alias("origin"), (F.col("c_custkey") % 25).cast("int").alias("primary_dest")
    )
    sample = sampled(spark, folder).withColumnRenamed("c_custkey", "trip_id").withColumnRenamed("choice", "dest")
    held = skims.lookup(legs(sample.select("trip_id", "dest"), trips), cube(spark, folder).where("period = 0"), ["DIST"], "leg_orig", "leg_dest")
    modes = utilities(held, LEG_SPEC)
    modes = modes.select("trip_id", "dest", "direction", *[F.col("utilities")[i].alias(name) for i, name in enumerate(LEG_SPEC.alternatives)])
    found = nested.logsum(modes, TREE).groupBy("trip_id", "dest").pivot("direction", ["od", "dp"]).agg(F.max("logsum"))
    rows = sample.join(found, ["trip_id", "dest"]).withColumn("utility", F.col("u") + F.col("od") * 0.3 + F.col("dp") * 0.2).withColumn("z", draw(F.col("trip_id"), 7))
    chosen = sampling.final_choice(rows.withColumnRenamed("dest", "choice"), "trip_id", "utility", "z")
    return chosen.select(F.col("trip_id").alias("c_custkey"), F.col("choice").cast("int").alias("dest"), rounded(F.col("logsum")).alias("logsum"))


FREQUENCY_OF_DAY = Spec(
    "mandatory_frequency",
    ("work1", "work2", "school1", "school2", "work_and_school"),
    ("autos", "balance", "jobs"),
    ("autos", "(c_acctbal / 1000).clip(-1, 6)", "jobs / 10"),
    ((0.0, 0.1, -0.1, 0.05, 0.0), (0.0, 0.1, -0.2, -0.1, 0.05), (0.0, 0.2, 0.1, 0.0, -0.1)),
)
BATCHES = 6
FIRST_OTHER = 10**12


def _day_batch(n: int) -> str:
    base = "-0.1::DOUBLE * abs(s - 8) - 0.05::DOUBLE * abs(e - 17) + 0.02::DOUBLE * (e - s)"
    if n == 1:
        return choose_sql("1", f"SELECT tour_id AS id, tdd.tdd AS alt, {base} AS util, {draw_sql('tour_id', 13)} AS z FROM tours CROSS JOIN tdd WHERE tour_num = 1")
    earlier = " UNION ALL ".join(f"SELECT id, choice FROM chosen{i}" for i in range(1, n))
    return f"""win{n} AS (SELECT person_id, p, bit_or(st) AS w FROM ({earlier}) x JOIN tours ON tours.tour_id = x.id JOIN state ON state.tdd = choice GROUP BY 1, 2),
    bad{n} AS (SELECT DISTINCT person_id AS pid, tdd FROM win{n} JOIN state USING (p) WHERE (st = 2 AND w IN (2, 7)) OR (st = 4 AND w IN (4, 7)) OR (st = 7) OR (st = 6 AND w = 7)),
    """ + choose_sql(
        str(n),
        f"""SELECT tour_id AS id, tdd.tdd AS alt, {base} + CASE WHEN a.w IN (4, 6) THEN 0.5::DOUBLE ELSE 0 END AS util, {draw_sql("tour_id", 13)} AS z FROM tours CROSS JOIN tdd
        LEFT JOIN bad{n} bad ON bad.pid = tours.person_id AND bad.tdd = tdd.tdd LEFT JOIN win{n} a ON a.person_id = tours.person_id AND a.p = s WHERE tour_num = {n} AND bad.tdd IS NULL""",
    )


@query(
    f"""WITH {_REGION_U} {choose_sql("a", f"SELECT id, alt, b1::DOUBLE*f1 + b2::DOUBLE*f2 + b3::DOUBLE*f3 + b4::DOUBLE AS util, {draw_sql('id')} AS z FROM f, b")},
    jobs AS (SELECT s_nationkey AS zone, count(*) AS jobs FROM supplier GROUP BY 1),
    y AS (SELECT c_custkey AS id, choosea.choice AS autos, least(greatest(c_acctbal / 1000, -1), 6) AS balance, coalesce(jobs, 0) / 10.0::DOUBLE AS jobs FROM customer JOIN chosena choosea ON choosea.id = c_custkey LEFT JOIN jobs ON zone = c_nationkey),
    q(alt, q1, q2, q3) AS (VALUES (0, 0.0, 0.0, 0.0), (1, 0.1, 0.1, 0.2), (2, -0.1, -0.2, 0.1), (3, 0.05, -0.1, 0.0), (4, 0.0, 0.05, -0.1)),
    {choose_sql("f", f"SELECT id, alt, q1::DOUBLE * autos + q2::DOUBLE * balance + q3::DOUBLE * jobs AS util, {draw_sql('id', 14)} AS z FROM y, q")},
    n AS (SELECT c_custkey AS person_id, choice AS c, c_acctbal > 2000 AS worker, 100 + c_nationkey AS work, 200 + c_nationkey AS school,
        CASE WHEN choice = 1 THEN 2 WHEN choice IN (0, 4) THEN 1 ELSE 0 END AS wc, CASE WHEN choice = 3 THEN 2 WHEN choice IN (2, 4) THEN 1 ELSE 0 END AS sc FROM customer JOIN chosenf ON id = c_custkey),
    tours AS (SELECT tour_id, person_id, tour_num FROM ({" UNION ALL ".join([_tour_sql(0, 1, 39, "wc >= 1", "1"), _tour_sql(0, 2, 40, "wc >= 2", "2"), _tour_sql(1, 1, 31, "sc >= 1", "wc + 1"), _tour_sql(1, 2, 32, "sc >= 2", "wc + 2")])})
        UNION ALL SELECT {FIRST_OTHER} + o_orderkey, o_custkey, wc + sc + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) FROM orders JOIN n ON person_id = o_custkey WHERE o_orderstatus = 'O'),
    {_CELLS}, {", ".join(_day_batch(n) for n in range(1, BATCHES + 1))}
    SELECT id AS tour_id, person_id, tour_num::INTEGER AS tour_num, choice AS tdd, logsum FROM ({" UNION ALL ".join(f"SELECT * FROM chosen{n}" for n in range(1, BATCHES + 1))}) x JOIN tours ON tours.tour_id = x.id
    UNION ALL SELECT tour_id, person_id, tour_num::INTEGER, -1, NULL FROM tours WHERE tour_num > {BATCHES}"""
)
def resident_chain(spark: SparkSession, folder: str) -> DataFrame:
    """A person's day from end to end: vehicles, how many mandatory tours, the tours, and six batches of schedules, each
    around the ones before; open orders are the tours after the mandatory ones (C2, C3, J1, T1-T6, T10, T12).

    A day has BATCHES scheduled tours at most: later ones are returned unscheduled, with a tdd of -1 and no logsum."""
    autos = region_choice(spark, folder).select("c_custkey", F.col("choice").alias("autos"))
    jobs = table(spark, folder, "supplier").groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.count(F.lit(1)).alias("jobs"))
    people = gather(table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_acctbal"), autos, ["c_custkey"], ["autos"])
    people = gather(people, jobs, ["c_nationkey"], ["jobs"], {"jobs": 0})
    chosen = choice.choose(utilities(people, FREQUENCY_OF_DAY).withColumn("z", draw(F.col("c_custkey"), 14)), "utilities", "z", width=5)
    zone = F.col("c_nationkey")
    persons = kept(
        chosen.select(
            F.col("c_custkey").alias("person_id"), zone.alias("household_id"), F.col("choice").alias("mtf_choice"), (F.col("c_acctbal") > 2000).alias("is_worker"),
            (zone + 100).alias("workplace_zone_id"), (zone + 200).alias("school_zone_id"), zone.alias("home_zone_id"),
        ),
        "persons",
    )
    mandatory = tours.mandatory(persons).select("tour_id", "person_id", "tour_num", "tour_count")
    counts = mandatory.groupBy("person_id").agg(F.count(F.lit(1)).alias("before"))
    own = Window.partitionBy("person_id").orderBy("o_orderkey")
    others = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("person_id"), "o_orderkey")
    others = gather(others.withColumn("nth", F.row_number().over(own)), counts, ["person_id"], ["before"])
    others = others.select((F.col("o_orderkey") + FIRST_OTHER).alias("tour_id"), "person_id", (F.col("before") + F.col("nth")).cast("int").alias("tour_num"))
    both = mandatory.select("tour_id", "person_id", F.col("tour_num").cast("int").alias("tour_num")).unionByName(others)
    held = kept(both.withColumn("z", draw(F.col("tour_id"), 13)), "tours")

    def utility(rows: DataFrame) -> DataFrame:
        base = F.abs(F.col("start") - 8) * -0.1 - F.abs(F.col("end") - 17) * 0.05 + F.col("duration") * 0.02
        return rows.withColumn("utility", base + F.when(F.col("previous_ends"), 0.5).otherwise(0.0))

    done = scheduling.schedule_batches(held, timetable.hourly(), utility, list(range(1, BATCHES + 1)), kept)
    rest = held.where(F.col("tour_num") > BATCHES).select("tour_id", "person_id", "tour_num", F.lit(-1).alias("tdd"), F.lit(None).cast("double").alias("logsum"))
    return done.unionByName(rest).select("tour_id", "person_id", "tour_num", "tdd", rounded(F.col("logsum")).alias("logsum"))
