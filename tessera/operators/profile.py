"""Province profiles and ETL steps over documents, pages and features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.numeric import parse_numeric
from tessera.functions.text import camel_split, normalize_admin_name, normalize_search, strict_json, strip_bom


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """name_key, doc (VARIANT, null if malformed) of each JSON file; byte-order marks are dropped."""
    files = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").text(folder).select("value", F.col("_metadata.file_name").alias("file_name"))
    stem = F.regexp_replace("file_name", r"\.json$", "")
    return files.select("file_name", normalize_admin_name(camel_split(stem)).alias("name_key"), strict_json(strip_bom(F.col("value"))).alias("doc"))


def leaf(doc: Column, path: str, kind: str = "string") -> Column:
    """The `value` of a wrapped leaf, or null if it is absent or of another type."""
    return F.try_variant_get(doc, f"$.{path}.value", kind)


def profile(documents: DataFrame) -> DataFrame:
    d = F.col("doc")
    numbers = {"latitude": "location.latitude", "longitude": "location.longitude", "area_km2": "area.total_km2", "population": "population.total", "density": "population.density_per_km2", "temperature": "environment.climate.average_temperature_c"}
    lists = {"former_provinces": "former_provinces", "seaports": "infrastructure.seaport", "airports": "infrastructure.airport", "railway": "infrastructure.railway_station", "other_transport": "infrastructure.other_transport"}
    out = documents.select("file_name", "name_key", d.isNotNull().alias("has_profile"), leaf(d, "administrative_code").alias("administrative_code"), *[parse_numeric(leaf(d, p), True).alias(n) for n, p in numbers.items()], *[leaf(d, p, "array<string>").alias(n) for n, p in lists.items()])
    none = F.array().cast("array<string>")
    return out.withColumn("infrastructure", F.concat(*[F.coalesce(c, none) for c in ("seaports", "airports", "railway", "other_transport")]))


def first_by_keys(rows: DataFrame, key: str, candidates: str, lookup: DataFrame, lookup_key: str, value: str, out: str) -> DataFrame:
    """rows with the value of the first of their candidate keys (an array, in order) that lookup has."""
    keyed = rows.select(key, F.posexplode(candidates).alias("at", "_k")).join(F.broadcast(lookup.select(F.col(lookup_key).alias("_k"), F.col(value).alias("_v"))), "_k")
    best = keyed.groupBy(key).agg(F.min_by("_v", "at").alias(out))
    return rows.join(best, key, "left")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def search_units(units: DataFrame, fields: list[str], query: str, kind_column: str, kind: str = "all") -> DataFrame:
    text = F.concat_ws(" ", *[F.col(f) for f in fields])
    hit = F.contains(normalize_search(text), normalize_search(F.trim(F.lit(query))))
    return units.where(hit if kind == "all" else hit & (F.col(kind_column) == kind))


def dissolve(features: DataFrame, mapping: DataFrame, name: str, code: str, geometry: str) -> DataFrame:
    """Features joined to their new code and gathered to one multipolygon each, in order of `ord`; membership of a
    point in the parts equals that in their union."""
    own = features.join(F.broadcast(mapping), name)
    return own.groupBy(code).agg(F.min("ord").alias("ord"), F.count("*").alias("parts"), F.transform(F.array_sort(F.collect_list(F.struct("ord", geometry))), lambda x: x[geometry]).alias("multipolygon"))


def knowledge(texts: DataFrame, key: str, order: list[str], text: str) -> DataFrame:
    return texts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias("knowledge"))
