"""Derived inputs of mode choice: waits, tour and trip columns, availability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.functions import ieee
from wayfare.operators.lookup import gather

SERVICES = ("taxi", "tnc_single", "tnc_shared")


def banded(land_use: DataFrame) -> DataFrame:
    """Adds density_band to zones."""
    return land_use.withColumn("density_band", ieee.density_band(F.col("TOTPOP"), F.col("TOTEMP"), F.col("TOTACRE")))


def by_band(band: Column, values: dict[int, float]) -> Column:
    out = F.lit(None).cast("double")
    for key, value in values.items():
        out = F.when(band == key, float(value)).otherwise(out)
    return out


def ridehail_waits(tours: DataFrame, means: dict[str, dict[int, float]], sds: dict[str, dict[int, float]]) -> DataFrame:
    """Adds a wait for each service: one draw at the origin and one at the destination, added up.

    ``tours`` has origin_band, destination_band and normals, six standard normal draws.
    """
    out = tours
    for i, service in enumerate(SERVICES):
        parts = []
        for j, end in enumerate(("origin_band", "destination_band")):
            mean, sd = by_band(F.col(end), means[service]), by_band(F.col(end), sds[service])
            parts.append(ieee.lognormal_wait(mean, sd, F.element_at("normals", i * 2 + j + 1)))
        out = out.withColumn(f"{service}_wait", parts[0] + parts[1])
    return out


def tour_columns(tours: DataFrame, land_use: DataFrame) -> DataFrame:
    """Tour mode inputs from both ends' zones: terminals, parking, inverse value of time and flags."""
    zones = land_use.select("zone_id", "TERMINAL", "PRKCST", "TOPOLOGY", "area_type")
    found = tours
    for end in ("origin", "destination"):
        source = zones.select(F.col("zone_id").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in zones.columns[1:]])
        found = gather(found, source, [end], source.columns[1:])
    free = F.col("free_parking_at_work") & (F.col("tour_type") == "work")
    return found.select(
        *tours.columns,
        (F.col("origin_TERMINAL") + F.col("destination_TERMINAL")).alias("total_terminal_time"),
        ieee.divide(F.lit(1.0), F.col("value_of_time")).alias("ivot"),
        F.when(free, 0.0).otherwise(F.col("destination_PRKCST").cast("double")).alias("daily_parking_cost"),
        F.col("origin_TOPOLOGY").alias("origin_topology"),
        (F.col("destination_area_type") == 0).alias("destination_in_cbd"),
        (F.col("number_of_participants") > 1).alias("is_joint"),
        (F.col("tour_category") == "mandatory").alias("is_mandatory"),
        (F.col("tour_type") == "escort").alias("is_escort"),
        (F.col("hhsize") - F.col("num_workers")).alias("non_workers"),
    )


def round_trip(out: Column, back: Column) -> Column:
    return (out > 0) & (back > 0)


#: Transit services from the local bus up, and the position of each on the tour-mode scale for access on foot and by car (fixed values).
TRANSIT = ("LOC", "LRF", "EXP", "HVY", "COM")
WALK_FROM = {"LOC": 9, "LRF": 10, "EXP": 11, "HVY": 12, "COM": 13}
DRIVE_FROM = {"LOC": 14, "LRF": 15, "EXP": 16, "HVY": 17, "COM": 18}


#: How both directions of an automobile matrix decide, and which services need time on their own line besides (fixed values).
AUTOS = {
    "sov": ("SOV_TIME", "both"),
    "sovtoll": ("SOVTOLL_VTOLL", "either"),
    "hov2": ("HOV2_TIME", "sum"),
    "hov2toll": ("HOV2TOLL_VTOLL", "sum"),
    "hov3": ("HOV3_TIME", "both"),
    "hov3toll": ("HOV3TOLL_VTOLL", "sum"),
}
SERVICES_BY_LINE = {"local": "LOC", "commuter": "COM", "express": "EXP", "heavyrail": "HVY", "lrf": "LRF", "ferry": "LRF"}


def tour_availability_columns() -> list[str]:
    """The matrix columns that ``tour_availability`` reads, each out and in."""
    legs = [f"out_{a}_{s}_WLK_{t}" for a in ("WLK", "DRV") for s in TRANSIT for t in ("TOTIVT", "KEYIVT")]
    legs += [f"in_WLK_{s}_{e}_{t}" for e in ("WLK", "DRV") for s in TRANSIT for t in ("TOTIVT", "KEYIVT")]
    ferry = ["out_WLK_LRF_WLK_FERRYIVT", "out_DRV_LRF_WLK_FERRYIVT", "in_WLK_LRF_WLK_FERRYIVT"]
    return [f"{way}_{key}" for key, _ in AUTOS.values() for way in ("out", "in")] + legs + ferry


def tour_availability(tours: DataFrame) -> DataFrame:
    """Adds the 18 availabilities of a tour's modes from out- and inbound matrix values, hundredths for transit.

    Reads ``tour_availability_columns`` and auto_ownership.  Transit needs time in vehicles both ways; all but the local
    bus also time on the service's own line, in one direction at least, and the ferry time aboard; driving to transit
    needs a car.
    """

    def total(out: str, back: str) -> Column:
        return F.col(f"out_{out}") / 100 + F.col(f"in_{back}") / 100

    found = {}
    for mode, (key, how) in AUTOS.items():
        out, back = F.col(f"out_{key}"), F.col(f"in_{key}")
        found[mode] = {"both": round_trip(out, back), "either": (out > 0) | (back > 0), "sum": out + back > 0}[how]
    for way, there, home in (("walk", "WLK", "WLK"), ("drive", "DRV", "DRV")):
        for service, line in SERVICES_BY_LINE.items():
            out, back = f"{there}_{line}_WLK", f"WLK_{line}_{home}"
            open_ = round_trip(F.col(f"out_{out}_TOTIVT") / 100, F.col(f"in_{back}_TOTIVT") / 100)
            if service != "local":
                open_ = open_ & (total(f"{out}_KEYIVT", f"{back}_KEYIVT") > 0)
            if service == "ferry":
                open_ = open_ & (total(f"{out}_FERRYIVT", "WLK_LRF_WLK_FERRYIVT") > 0)
            found[f"{way}_{service}"] = open_ & (F.col("auto_ownership") > 0) if way == "drive" else open_
    return tours.withColumns({f"{mode}_available": value for mode, value in found.items()})


def trip_availability(trips: DataFrame) -> DataFrame:
    """Adds availability of transit for a trip: time above 0 and a tour mode that reaches it.

    A walk service needs a tour mode at its place on the scale or beyond; a drive service also a car, and the
    outbound direction from home or the inbound to it.
    """
    mode = F.col("i_tour_mode")
    out = trips
    for service in TRANSIT:
        walk = (F.col(f"WLK_{service}") > 0) & (mode >= WALK_FROM[service])
        leg = F.when(F.col("outbound"), F.col(f"DRV_{service}")).otherwise(F.col(f"BRV_{service}"))
        drive = (leg > 0) & (F.col("auto_ownership") > 0) & (mode >= DRIVE_FROM[service])
        out = out.withColumn(f"walk_{service.lower()}_available", walk).withColumn(f"drive_{service.lower()}_available", drive)
    return out


def trip_columns(trips: DataFrame, land_use: DataFrame) -> DataFrame:
    """Trip mode inputs: terminal time by direction, hourly parking at the destination, flags."""
    zones = land_use.select("zone_id", F.col("TERMINAL").cast("double").alias("terminal"), F.col("PRKCST").cast("double").alias("parking"))
    found = trips
    for end in ("origin", "destination"):
        source = zones.select(F.col("zone_id").alias(end), F.col("terminal").alias(f"{end}_terminal"), F.col("parking").alias(f"{end}_parking"))
        found = gather(found, source, [end], [f"{end}_terminal", f"{end}_parking"])
    toward = F.when(F.col("outbound"), F.col("destination_terminal")).otherwise(F.col("origin_terminal"))
    first = F.when(F.col("outbound"), F.col("trip_num") == 1).otherwise(F.col("trip_num") == F.col("trip_count"))
    return found.withColumn("terminal_time", toward).withColumn("first_trip", first).withColumn(
        "parking_cost", F.when(F.col("free_parking"), 0.0).otherwise(F.col("destination_parking"))
    )
