"""Tour expansion and the specification of daily activity patterns."""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tours that a person may have; places of work 1, work 2, school 1 and school 2 among them (fixed values).
POSSIBLE, PLACES = 41, (39, 40, 31, 32)
WORK1, WORK2, SCHOOL1, SCHOOL2, WORK_AND_SCHOOL = range(5)


def mandatory(persons: DataFrame) -> DataFrame:
    """One or two tours for each person's choice 0..4 (one or two of work, of school, or one of each): T10.

    A person who does not work and takes both goes to school first.
    """
    choice = F.col("mtf_choice")
    work = F.when(choice == WORK2, 2).when(choice.isin(WORK1, WORK_AND_SCHOOL), 1).otherwise(0)
    school = F.when(choice == SCHOOL2, 2).when(choice.isin(SCHOOL1, WORK_AND_SCHOOL), 1).otherwise(0)
    held = persons.withColumn("_work", work).withColumn("_school", school)

    def tour(kind: int, number: int, place: int):
        count = F.col("_school" if kind else "_work")
        position = F.col("_work") + number if kind else F.lit(number)
        return F.struct(
            F.lit(kind).alias("tour_type"), F.lit(number).alias("tour_type_num"), count.alias("tour_type_count"), position.alias("position"), F.lit(place).alias("place")
        )

    slots = F.array(tour(0, 1, PLACES[0]), tour(0, 2, PLACES[1]), tour(1, 1, PLACES[2]), tour(1, 2, PLACES[3]))
    each = held.select("*", F.inline(F.filter(slots, lambda t: t["tour_type_num"] <= t["tour_type_count"])))
    swap = (choice == WORK_AND_SCHOOL) & ~F.col("is_worker")
    return each.select(
        (F.col("person_id") * POSSIBLE + F.col("place")).alias("tour_id"),
        "person_id",
        "household_id",
        "tour_type",
        "tour_type_count",
        "tour_type_num",
        F.when(swap, 3 - F.col("position")).otherwise(F.col("position")).alias("tour_num"),
        (F.col("_work") + F.col("_school")).alias("tour_count"),
        F.lit(0).alias("tour_category"),
        F.lit(1).alias("number_of_participants"),
        F.when(F.col("tour_type") == 0, F.col("workplace_zone_id")).otherwise(F.col("school_zone_id")).alias("destination"),
        F.col("home_zone_id").alias("origin"),
    )


def pattern_alternatives(size: int) -> list[str]:
    """Patterns of a household: home, mandatory or other for each person, and again with a joint tour
    where two or more leave home (T11)."""
    plain = ["".join(p) for p in product("HMN", repeat=size)]
    return plain + [p + "J" for p in plain if sum(x != "H" for x in p) > 1] if size > 1 else plain


def pattern_terms(size: int, joint: int = 2) -> list[tuple[str, list[str]]]:
    """(term, alternatives it enters): a term for each person and activity, and for each set of two or three
    persons with the same activity; ``joint`` persons or more leaving home allow a joint tour."""
    patterns = pattern_alternatives(size)
    terms = [(f"{a}_p{i + 1}", [p for p in patterns if p[i] == a]) for i in range(size) for a in "HMN"]
    for count in (2, 3):
        for who in combinations(range(size), count):
            for a in "HMN":
                name = f"{a}_" + "_".join(f"p{i + 1}" for i in who)
                terms.append((name, [p for p in patterns if all(p[i] == a for i in who)]))
    if size >= joint:
        terms.append(("joint", [p for p in patterns if p.endswith("J")]))
    return terms
