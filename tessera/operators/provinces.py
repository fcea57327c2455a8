"""The province catalogue: summaries, keys, documents and snapshots by key, details by code, and their display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lookup, numeric
from tessera.functions.geo import label_point, largest_polygon
from tessera.functions.text import normalize_admin_name, vietnamize
from tessera.operators.resolve import free_name
from tessera.sources import seeds

# The message of an unknown province, and the map's colours.
NOT_FOUND = "Không tìm thấy tỉnh/thành."
SELECTED, PLAIN = "#e25f3f", "#86c8c3"


def summaries(spark) -> DataFrame:
    return seeds.provinces(spark).select("ord", "province_id", "province_code", "province_name", "province_kind", "aliases", "description")


def _keys(*names: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.array(*names), normalize_admin_name), lambda k: k != ""))


def lookup_keys(name: Column, code: Column, aliases: Column) -> Column:
    """Normalised keys of a province, in the order in which they are tried."""
    own = F.array(name, code, F.replace(code, F.lit("-"), F.lit(" ")), F.replace(F.regexp_replace(code, "-city$", ""), F.lit("-"), F.lit(" ")))
    return F.array_distinct(F.filter(F.transform(F.concat(own, F.coalesce(aliases, F.array().cast("array<string>"))), normalize_admin_name), lambda k: k != ""))


def snapshot_keys(name: Column, full: Column, slug: Column) -> Column:
    return _keys(name, full, F.replace(slug, F.lit("-"), F.lit(" ")))


def last_by_key(rows: DataFrame, keys: str, order: str, value: str) -> DataFrame:
    """key, value: of each key in the rows' arrays the value of the last row that has it."""
    return rows.select(F.explode(keys).alias("key"), F.col(order).alias("_ord"), F.col(value).alias("_value")).groupBy("key").agg(F.max_by("_value", "_ord").alias("value"))


def first_by_keys(rows: DataFrame, keys: str, table: DataFrame, out: str) -> DataFrame:
    """rows with the value of the first of their keys (an array, in order) that table (key, value) has, else null.

    Rows are told apart by nothing: equal arrays of keys are looked up once."""
    asked = rows.select(F.col(keys).alias("_keys")).distinct()
    hit = asked.select("_keys", F.posexplode("_keys").alias("_at", "_key")).join(table.select(F.col("key").alias("_key"), F.col("value").alias("_value")), "_key")
    best = hit.groupBy("_keys").agg(F.min_by("_value", "_at").alias("_best"))
    joined = rows.select(F.struct("*").alias("_row"), F.col(keys).alias("_keys")).join(best, "_keys", "left")
    return joined.select("_row.*", F.col("_best").alias(free_name(rows, out)))


def shown_snapshot(snapshot: Column) -> Column:
    """A snapshot for display: its centre and its source's note."""
    note = vietnamize(snapshot["source"]["note"])
    return snapshot.withField("administrative_center", vietnamize(snapshot["administrative_center"])).withField("source.note", F.coalesce(note, snapshot["source"]["note"]))


def details(requests: DataFrame, code: str, documents: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests with status (200 or 404), message, the province's summary, commune_count, province_info and
    reference_snapshot. documents and snapshots: key, value of what each province is looked up by."""
    catalogue = summaries(requests.sparkSession).withColumn("keys", lookup_keys(F.col("province_name"), F.col("province_code"), F.col("aliases"))).withColumn("commune_count", F.coalesce(lookup.commune_count(F.col("province_code")), F.lit(0)))
    catalogue = first_by_keys(first_by_keys(catalogue, "keys", documents, "province_info"), "keys", snapshots, "reference_snapshot")
    own = F.struct("province_id", "province_code", "province_name", "province_kind", "aliases", "description", "commune_count", "province_info", "reference_snapshot")
    table = F.broadcast(catalogue.select(F.col("province_code").alias("_code"), own.alias("_detail")))  # 34 rows
    rows = requests.select(F.struct("*").alias("_row"), F.col(code).alias("_asked")).join(table, F.col("_asked") == F.col("_code"), "left")
    found = F.col("_detail").isNotNull()
    return rows.select("_row.*", F.when(found, 200).otherwise(404).alias(free_name(requests, "status")), F.when(~found, NOT_FOUND).alias(free_name(requests, "message")), F.col("_detail").alias(free_name(requests, "detail")))


def display(snapshot: Column, profile: Column, code: Column) -> Column:
    """What a province's page shows: a snapshot's fields before its profile's. Lists of a snapshot win even if empty."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(snapshot["province_code_text"], profile["administrative_code"], code).alias("admin_code"),
        F.coalesce(snapshot["area_km2"], profile["area_km2"]).alias("area_km2"),
        F.coalesce(snapshot["population"], profile["population"]).alias("population"),
        profile["density"].alias("density"),
        F.coalesce(snapshot["total_unit"], profile["total_units"]).alias("total_units"),
        F.concat(F.coalesce(snapshot["border_with_provinces"], profile["neighbours"], none), F.coalesce(profile["countries"], none)).alias("neighbours"),
    )


def ethnic_group(item: Column) -> Column:
    """A group as it is shown: text as it is, an object as its name with its share, if it has one."""
    kind = F.schema_of_variant(item)
    name, share = F.try_variant_get(item, "$.name", "string"), F.try_variant_get(item, "$.percentage", "double")
    return F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(share.isNull(), name).otherwise(F.concat(name, F.lit(" ("), numeric.format_vi(share, 2), F.lit("%)")))


def feature_by_code(features: DataFrame, code: str) -> DataFrame:
    return features.where(F.col("province_code") == code)


def fill_colour(code: Column, selected: Column) -> Column:
    return F.when(code == F.coalesce(selected, F.lit("")), SELECTED).otherwise(PLAIN)


def labels(features: DataFrame, geometry: str = "geometry") -> DataFrame:
    """features with the point of their label: the middle of the largest polygon's outer ring."""
    ring = F.get(largest_polygon(F.col(geometry)), F.lit(0))
    return features.withColumn(free_name(features, "label"), label_point(ring))


def ward_types(units: DataFrame, key: str, order: str, kind: str = "ward_type") -> DataFrame:
    """key, types: the distinct types of each key's units in the order in which they first appear."""
    first = units.groupBy(key, kind).agg(F.min(order).alias("_first"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", kind))), lambda x: x[kind]).alias("types"))


def in_vietnamese_order(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*[F.collate(F.col(c), "vi") for c in columns])


def place_in_order(rows: DataFrame, column: str, out: str = "place") -> DataFrame:
    """rows of a small table with their place in Vietnamese order."""
    return rows.withColumn(free_name(rows, out), F.row_number().over(Window.orderBy(F.collate(F.col(column), "vi"))))
