"""Points and names to administrative units: the decision chain over the lookups, and the tables of names.

Nothing here joins or shuffles the requests: every lookup is an expression (tessera/functions/lookup.py). Each step
works in a struct of its own beside the caller's columns, so those may have any name and rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import lookup
from tessera.functions.geo import valid_coordinates
from tessera.functions.text import blank_as_null, infer_commune_type, normalize_admin_name
from tessera.sources import seeds


def free_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def aliases(spark) -> DataFrame:
    """entity_type, entity_code, raw_name, normalized_name of both levels."""

    def flat(df, kind, code, name):
        return df.select(F.lit(kind).alias("entity_type"), F.col(code).alias("entity_code"), F.explode(F.concat(F.array(name), "aliases")).alias("raw_name")).withColumn("normalized_name", normalize_admin_name(F.col("raw_name")))

    return flat(seeds.provinces(spark), "province", "province_code", "province_name").unionByName(flat(seeds.communes(spark), "commune", "commune_code", "commune_name"))


def recorded_zone(lat: Column, lon: Column) -> Column:
    """The answer of the recorded geocoder: current and legacy candidate (null outside of all zones)."""

    def answer(zone: Column) -> Column:
        def joined(*parts: Column) -> Column:
            return F.concat_ws(", ", *parts, F.lit("Việt Nam"))

        cc, cp, lc, ld, lp = (lookup.zone_field(zone, f) for f in lookup.ZONE_FIELDS)
        # One zone's current candidate names a district.
        current_district = F.when(zone == "hanoi-core", "quận Ba Đình")
        near = F.format_string("Mock reverse geocode near %.4f, %.4f", lat, lon)
        current = F.struct(
            F.when(zone.isNotNull(), joined(cc, cp)).otherwise(near).alias("formatted_address"), cc.alias("commune"), current_district.alias("district"), cp.alias("province"), F.lit("mock").alias("provider_name"), F.coalesce(zone, F.lit("fallback")).alias("payload")
        )
        legacy = F.when(zone.isNotNull(), F.struct(joined(lc, ld, lp).alias("formatted_address"), lc.alias("commune"), ld.alias("district"), lp.alias("province"), F.lit("mock").alias("provider_name"), zone.alias("payload")))
        return F.struct(current.alias("current"), legacy.alias("legacy"))

    return lookup.let(lookup.zone_at(lat, lon), answer)


# Notes of a resolution.
NO_POLYGON = "Point-in-polygon không tìm thấy tỉnh/thành phù hợp trong tập polygon hiện có."
CONFLICT = ("Provider trả về ", ", nhưng point-in-polygon xác định ", "; ưu tiên point-in-polygon.")
BY_POLYGON = "Provider không trả về tên xã/phường rõ ràng nên dùng polygon commune làm gợi ý phụ."
BY_CROSSWALK = "Xã/phường hiện tại được xác định qua crosswalk từ tên địa giới cũ."
NO_PROVINCE = "Không xác định được tỉnh/thành hiện tại cho điểm đã chọn."
# What is wrong with coordinates.
BAD_LAT, BAD_LON = "Vĩ độ phải là số hợp lệ.", "Kinh độ phải là số hợp lệ."
LAT_RANGE, LON_RANGE = "Vĩ độ phải nằm trong khoảng từ -90 đến 90.", "Kinh độ phải nằm trong khoảng từ -180 đến 180."


def coordinate_error(lat: Column, lon: Column) -> Column:
    """What is wrong with a point, or null."""
    return F.when(lat.isNull() | F.isnan(lat), BAD_LAT).when(lon.isNull() | F.isnan(lon), BAD_LON).when(~lat.between(-90, 90), LAT_RANGE).when(~lon.between(-180, 180), LON_RANGE)


def resolution(lat: Column, lon: Column, bundle: Column, provider: str = "mock") -> Column:
    """The response for a point and a geocoder's bundle of candidates (current, legacy or null): normalized, legacy_match,
    current_match, alternatives, confidence, resolution_path, debug. For a point that is none, `error` alone is set."""

    def find(x: Column) -> Column:
        cur = x["bundle"]["current"]
        return F.struct(
            x["lat"].alias("lat"), x["lon"].alias("lon"), x["bundle"].alias("bundle"), coordinate_error(x["lat"], x["lon"]).alias("error"),
            lookup.province_at(x["lat"], x["lon"]).alias("by_polygon"), lookup.province_of_name(cur["province"]).alias("by_name"),
        )

    def match(x: Column) -> Column:
        cur, old, province = x["bundle"]["current"], x["bundle"]["legacy"], F.coalesce(x["by_polygon"], x["by_name"])
        return F.struct(
            x.alias("x"), province.alias("province"),
            lookup.commune_at(x["lat"], x["lon"], province).alias("polygon"),
            lookup.commune_ladder(province, cur["commune"]).alias("ladder"),
            lookup.legacy_crosswalk(old["commune"], old["district"], old["province"]).alias("crosswalk"),
            (blank_as_null(cur["commune"])).alias("given"),
        )

    def respond(m: Column) -> Column:
        x, province, ladder, given = m["x"], m["province"], m["ladder"], m["given"]
        cur, old = x["bundle"]["current"], x["bundle"]["legacy"]
        unique = ladder["match"].isNotNull()
        by_polygon = ~unique & given.isNull() & m["polygon"].isNotNull()
        crosswalk = ~unique & ~by_polygon & m["crosswalk"].isNotNull()
        code = F.when(unique, ladder["match"]).when(by_polygon, m["polygon"]).when(crosswalk, m["crosswalk"])
        conflict = F.coalesce(x["by_polygon"] != x["by_name"], F.lit(False))
        name = lambda c: lookup.province_fact(c, "province_name")
        normal = lambda c: F.when(c != "", normalize_admin_name(c))
        notes = F.array(
            F.when(x["by_polygon"].isNull(), NO_POLYGON),
            F.when(conflict, F.concat(F.lit(CONFLICT[0]), name(x["by_name"]), F.lit(CONFLICT[1]), name(x["by_polygon"]), F.lit(CONFLICT[2]))),
            F.when(by_polygon, BY_POLYGON),
            lookup.by_key(lookup.EXPLANATION, ladder["step"]),
            F.when(crosswalk, BY_CROSSWALK),
            F.when(province.isNull(), NO_PROVINCE),
        )
        path = F.array(F.lit("province_polygon"), F.lit(f"{provider}_reverse_geocode"), F.lit("normalize_names"), F.lit("current_ward_lookup_within_resolved_province"), F.when(crosswalk, "legacy_commune_crosswalk"))
        confidence = F.when(province.isNull(), "low").when(unique, "high").when(by_polygon | given.isNotNull(), "medium").otherwise("low")
        current = F.struct(
            province.alias("province_code"),
            name(province).alias("province_name"),
            code.alias("commune_code"),
            F.when(code.isNotNull(), lookup.commune_fact(code, "commune_name")).otherwise(cur["commune"]).alias("commune_name"),
            F.when(code.isNotNull(), lookup.commune_fact(code, "commune_type")).when(given.isNotNull(), infer_commune_type(given)).alias("commune_type"),
        )
        normalized = F.struct(
            normal(cur["commune"]).alias("current_commune_or_ward"), normal(cur["province"]).alias("current_province"), normal(old["commune"]).alias("legacy_commune_or_ward"), normal(old["province"]).alias("legacy_province")
        )
        legacy = F.struct(old["commune"].alias("legacy_commune_or_ward"), old["district"].alias("legacy_district"), old["province"].alias("legacy_province"))
        debug = F.struct(
            x["by_polygon"].isNotNull().alias("province_polygon_match"), m["polygon"].isNotNull().alias("commune_polygon_match"), unique.alias("unique_commune_match"),
            crosswalk.alias("crosswalk_used"), conflict.alias("provider_conflict"), F.array_compact(notes).alias("notes"),
        )
        sound = x["error"].isNull()
        parts = {"normalized": normalized, "legacy_match": legacy, "current_match": current, "alternatives": ladder["alternatives"], "confidence": confidence, "resolution_path": F.array_compact(path), "debug": debug}
        return F.struct(x["error"].alias("error"), *[F.when(sound, v).alias(k) for k, v in parts.items()])

    start = F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"), bundle.alias("bundle"))
    return lookup.let(lookup.let(lookup.let(start, find), match), respond)


def resolve(points: DataFrame, bundle: Column | None = None, provider: str = "mock", out: str = "resolution", lat: str = "lat", lon: str = "lon") -> DataFrame:
    """points with their resolution in the column `out` (which gets underscores if points has it). bundle: a geocoder's
    answer for each point, from the recorded zones if not given."""
    at = F.col(lat), F.col(lon)
    return points.withColumn(free_name(points, out), resolution(*at, recorded_zone(*at) if bundle is None else bundle, provider))


def flat(resolved: DataFrame, out: str = "resolution") -> DataFrame:
    """The main facts of a resolution as columns beside the caller's."""
    r = F.col(out)
    keep = [c for c in resolved.columns if c != out]
    current, debug = r["current_match"], r["debug"]
    facts = {
        "province_code": current["province_code"],
        "commune_code": current["commune_code"],
        "commune_type": current["commune_type"],
        "confidence": F.coalesce(r["confidence"], F.lit("error")),
        "polygon_commune": F.coalesce(debug["commune_polygon_match"], F.lit(False)),
        "crosswalk_used": F.coalesce(debug["crosswalk_used"], F.lit(False)),
        "conflict": F.coalesce(debug["provider_conflict"], F.lit(False)),
    }
    return resolved.select(*keep, *[v.alias(k) for k, v in facts.items()])


__all__ = ["aliases", "coordinate_error", "flat", "free_name", "recorded_zone", "resolution", "resolve", "valid_coordinates"]
