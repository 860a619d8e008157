"""Quantities, property sets, plausibility limits and the matching of model elements to their rows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import outline, shoelace

# Property sets by element class, their default properties, and typical ranges in metres.
PROPERTY_SETS = {
    "IfcWall": ("Pset_WallCommon", "Qto_WallBaseQuantities"),
    "IfcDoor": ("Pset_DoorCommon", "Qto_DoorBaseQuantities"),
    "IfcWindow": ("Pset_WindowCommon", "Qto_WindowBaseQuantities"),
    "IfcSlab": ("Pset_SlabCommon", "Qto_SlabBaseQuantities"),
    "IfcSpace": ("Pset_SpaceCommon", "Qto_SpaceBaseQuantities"),
}
DEFAULTS = {
    "IfcWall": {"Reference": "", "IsExternal": False, "FireRating": "", "ThermalTransmittance": 0.0, "LoadBearing": False, "AcousticRating": "", "Combustible": False, "SurfaceSpreadOfFlame": "", "ExtendToStructure": False},
    "IfcDoor": {"Reference": "", "IsExternal": False, "FireRating": "", "AcousticRating": "", "SecurityRating": "", "HandicapAccessible": False, "FireExit": False, "SelfClosing": False, "SmokeStop": False, "HasDrive": False},
    "IfcWindow": {"Reference": "", "IsExternal": True, "FireRating": "", "AcousticRating": "", "ThermalTransmittance": 0.0, "GlazingAreaFraction": 0.7, "SmokeStop": False},
    "IfcSlab": {"Reference": "", "IsExternal": False, "FireRating": "", "LoadBearing": True, "AcousticRating": "", "Combustible": False},
    "IfcSpace": {"Reference": "", "IsExternal": False, "PubliclyAccessible": False, "HandicapAccessible": False, "GrossPlannedArea": 0.0, "NetPlannedArea": 0.0},
}
LIMITS = {
    "IfcDoor": {"width": (0.5, 2.5), "height": (1.5, 3.5)},
    "IfcWindow": {"width": (0.3, 3.0), "height": (0.3, 2.5)},
    "IfcWall": {"thickness": (0.05, 1.0), "length": (0.2, 30.0)},
}


def quantities(ifc_class: str, record: dict, slab_thickness: float) -> dict[str, float]:
    """Quantities of one document record, the same as the tables below hold."""
    if ifc_class in ("IfcDoor", "IfcWindow"):
        return {"Width": record["width"], "Height": record["height"], "Area": record["width"] * record["height"]}
    if ifc_class == "IfcWall":
        n, h, t = math.dist(record["start"], record["end"]), record["height"], record["thickness"]
        return {"Length": n, "Height": h, "Width": t, "GrossFootprintArea": n * t, "GrossSideArea": n * h, "GrossVolume": n * h * t, "NetVolume": n * h * t}
    ring = [*record["boundary"], *record["boundary"][:1]]
    area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in itertools.pairwise(ring))) / 2
    if ifc_class == "IfcSlab":
        return {"Width": slab_thickness, "GrossArea": area, "GrossVolume": area * slab_thickness}
    around = sum(math.dist(a, b) for a, b in itertools.pairwise(ring))
    return {"GrossFloorArea": area, "NetFloorArea": area, "GrossVolume": area * record["height"], "GrossPerimeter": around, "Height": record["height"]}


def warnings_of(ifc_class: str, name: str, record: dict) -> list[str]:
    """Messages of `out_of_range` for one document record."""
    values = {k: record[k] for k in LIMITS.get(ifc_class, {}) if k in record}
    if ifc_class == "IfcWall":
        values["length"] = math.dist(record["start"], record["end"])
    limits = LIMITS.get(ifc_class, {})
    return [f"{name} {k} {v:.2f}m outside typical range [{limits[k][0]}, {limits[k][1]}]m" for k, v in values.items() if not limits[k][0] <= v <= limits[k][1]]


def wall_quantities(walls: DataFrame) -> DataFrame:
    n, h, t = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")), F.col("height"), F.col("thickness")
    return walls.select("scan_id", "wall_id", n.alias("Length"), h.alias("Height"), t.alias("Width"), (n * t).alias("GrossFootprintArea"), (n * h).alias("GrossSideArea"), (n * h * t).alias("GrossVolume"), (n * h * t).alias("NetVolume"))


def opening_quantities(openings: DataFrame, key: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    return openings.select(key, w.alias("Width"), h.alias("Height"), (w * h).alias("Area"))


def space_quantities(rooms: DataFrame) -> DataFrame:
    """rooms: scan_id, room_id, boundary (array of [x, y]), height."""
    area = shoelace(F.col("boundary"))
    return rooms.select("scan_id", "room_id", area.alias("GrossFloorArea"), area.alias("NetFloorArea"), (area * F.col("height")).alias("GrossVolume"), outline(F.col("boundary")).alias("GrossPerimeter"), F.col("height").alias("Height"))


def slab_quantities(rooms: DataFrame, thickness: float) -> DataFrame:
    area = shoelace(F.col("boundary"))
    return rooms.select("scan_id", "room_id", F.lit(thickness).alias("Width"), area.alias("GrossArea"), (area * F.lit(thickness)).alias("GrossVolume"))


def property_table(spark: SparkSession) -> DataFrame:
    """ifc_class, pset, qto, property, value (as text), one row per default property."""
    rows = [(c, *PROPERTY_SETS[c], k, str(v)) for c, ps in DEFAULTS.items() for k, v in ps.items()]
    return spark.createDataFrame(rows, "ifc_class string, pset string, qto string, property string, value string")


def merged_properties(dictionary: DataFrame, defaults: DataFrame) -> DataFrame:
    """Properties of a class: the dictionary's (ifc_class, property, data_type), blank by type, under the defaults'."""
    kind = F.lower("data_type")
    blank = F.when(kind.contains("bool"), "False").when(kind.contains("real") | kind.contains("number") | kind.contains("float"), "0.0").when(kind.contains("int"), "0").otherwise("")
    blanks = dictionary.select("ifc_class", "property", blank.alias("blank"))
    both = blanks.join(defaults.select("ifc_class", "property", "value"), ["ifc_class", "property"], "full")
    return both.select("ifc_class", "property", F.coalesce("value", "blank").alias("value"))


def best_class_hit(hits: DataFrame) -> DataFrame:
    """Per label the hit (label, position, name, uri) to use: the first whose name equals the label or whose uri holds it, else the first."""
    low = F.lower("label")
    match = (F.lower("name") == low) | F.lower("uri").contains(low)
    return hits.groupBy("label").agg(F.min_by(F.struct("name", "uri"), F.struct((~match).cast("int").alias("m"), "position")).alias("h")).select("label", "h.name", "h.uri")


def limit_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, p, lo, hi) for c, ps in LIMITS.items() for p, (lo, hi) in ps.items()], "ifc_class string, property string, lo double, hi double")


def out_of_range(elements: DataFrame) -> DataFrame:
    """Warnings for elements (name, ifc_class, property, value) outside the typical range of their class."""
    limits = F.broadcast(limit_table(elements.sparkSession))
    text: Column = F.concat("name", F.lit(" "), "property", F.lit(" "), F.format_string("%.2f", "value"), F.lit("m outside typical range ["), F.col("lo").cast("string"), F.lit(", "), F.col("hi").cast("string"), F.lit("]m"))
    return elements.join(limits, ["ifc_class", "property"]).where((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).select("name", "ifc_class", "property", "value", "lo", "hi", text.alias("message"))


def matched(elements: DataFrame, rows: DataFrame) -> DataFrame:
    """Elements (name) with the row (id) named after their first dash; elements without one keep null."""
    suffix = F.when(F.col("name").contains("-"), F.regexp_extract("name", r"^[^-]*-(.*)$", 1)).otherwise(F.lit(""))
    return elements.withColumn("id", suffix).join(rows, "id", "left")
