"""Building reference tables: features dissolved to new units, communes from map elements, snapshots from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import lookup, numeric, text
from tessera.operators.resolve import free_name

# A unit record up to its ward code: enough to tell a code's first record, the only one that is read whole.
_HEAD = r'\{"id":\d+,"created_at":"[^"]+","ward_order":(\d+),"ward_name":"([^"]+)","ward_code":"([^"]+)"'
UNIT = _HEAD + (
    r',"ward_type":"([^"]+)","admin_center":"([^"]*)","merger_from":"([^"]*)",'
    r'"province_id_ref":\d+,"province_code":\d+,"province_name":"([^"]+)","population":"?([^",]+)"?,"area":([^,}]+),"longitude":[^,}]+,"latitude":[^,}]+,"ward_ref_code":\d+,"tree_code":\d+,'
    r'"district":"[^"]*","search_normalized":"[^"]*","ward_slug":"([^"]+)","province_slug":"([^"]+)","updated_at":"[^"]+","old_province_name":(?:null|"[^"]*"),"old_province_slug":(?:null|"[^"]*"),"old_district":"([^"]*)"\}'
)
SUMMARY = r'\{"id":\d+,"province_name":"[^"]+","type":"[^"]+","province_code":"[^"]+","province_name_full":"[^"]+"[^\n\r]*?"public_service_id":"?[^"}]+"?\}'
# Narrative forms of a page's facts.
_GAP = r"(?:\s*<!-- -->\s*)*"
_STRONG = rf"là<strong[^>]*>{_GAP}([^<]+)"
PLATES = rf"(?i)các biển số xe:<strong[^>]*>{_GAP}([^<]+)<"
SECRETARY = rf"(?iu)Bí thư{_GAP}(?:Tỉnh ủy)?(?:\s|<[^>]+>)*{_STRONG}"
CHAIRMAN = rf"(?iu)Chủ tịch UBND(?:\s|<[^>]+>)*{_STRONG}"
FIGURE = '{}:</span><span class="font-medium">([^<]+)'
UPDATE = r"Cập nhật theo quyết định sáp nhập 34 tỉnh thành</h3><p[^>]*>([^\n\r]*?)</p>"
BOUNDARY = "Thông tin hành chính và biên giới"
OVERVIEW = "Tổng quan về "


# ---- features of former units to features of new ones ----


def unmatched(features: DataFrame, mapping: DataFrame, name: str = "name") -> DataFrame:
    """The features whose name leads to no new unit."""
    return features.join(F.broadcast(mapping.select(F.col(name).alias("_name")).distinct()), F.col(name) == F.col("_name"), "left_anti")


def merged_features(features: DataFrame, mapping: DataFrame, units: DataFrame, name: str = "name", geometry: str = "geometry") -> DataFrame:
    """Features (ord, name, geometry: array of polygons) joined to new codes and gathered to one multipolygon each.

    Gives province_id (p-001 ... in the order of first appearance), code, name, kind, parts, geometry. Membership of a
    point in the gathered polygons is that of their union; a feature without polygons adds none. mapping and units are
    small tables of fixed size."""
    codes = F.broadcast(mapping.select(F.col(name).alias("_name"), F.col("province_code").alias("_code")))
    own = features.join(codes, F.col(name) == F.col("_name")).select("_code", F.col("ord").alias("_ord"), F.col(geometry).alias("_geometry"))
    grouped = own.groupBy("_code").agg(F.min("_ord").alias("_first"), F.count("*").alias("parts"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_ord", "_geometry"))), lambda x: F.coalesce(x["_geometry"], F.slice(x["_geometry"], 1, 0)))).alias("geometry"))
    known = grouped.join(F.broadcast(units.select("province_code", "province_name", "province_kind")), F.col("_code") == F.col("province_code"))
    number = F.row_number().over(Window.orderBy("_first"))  # at most one row a unit
    return known.select(F.format_string("p-%03d", number).alias("province_id"), "province_code", "province_name", "province_kind", "parts", "geometry")


# ---- map elements to communes ----


def element_records(elements: DataFrame) -> DataFrame:
    """elements (name_vi, name, lat, lon, ...) with the struct `record`: skipped (no_name, no_centre, no_province) or
    null, province_code, commune_code, commune_name, commune_type."""

    def read(x: Column) -> Column:
        skipped = F.when(F.coalesce(x["name"], F.lit("")) == "", "no_name").when(x["lat"].isNull() | x["lon"].isNull(), "no_centre").when(x["province"].isNull(), "no_province")
        good = skipped.isNull()
        return F.struct(
            skipped.alias("skipped"),
            F.when(good, x["province"]).alias("province_code"),
            F.when(good, text.to_code(x["province"], x["name"])).alias("commune_code"),
            F.when(good, x["name"]).alias("commune_name"),
            F.when(good, text.infer_commune_type(x["name"], True)).alias("commune_type"),
        )

    found = F.struct(F.coalesce("name_vi", "name").alias("name"), F.col("lat").alias("lat"), F.col("lon").alias("lon"), lookup.province_at(F.col("lat"), F.col("lon")).alias("province"))
    return elements.withColumn(free_name(elements, "record"), lookup.let(found, read))


def communes_by_province(records: DataFrame, record: str = "record") -> DataFrame:
    """province_code, n, communes: each province's communes in Vietnamese order, provinces by code."""
    r = F.col(record)
    own = records.where(r["skipped"].isNull()).select(r.alias("r"))
    item = F.struct(F.collate(F.col("r.commune_name"), "vi").alias("key"), F.col("r.commune_code").alias("commune_code"), F.col("r.commune_name").alias("commune_name"), F.col("r.commune_type").alias("commune_type"))
    bare = lambda c: F.struct(c["commune_code"].alias("commune_code"), c["commune_name"].alias("commune_name"), c["commune_type"].alias("commune_type"))
    return own.groupBy(F.col("r.province_code").alias("province_code")).agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(item)), bare).alias("communes")).orderBy("province_code")


def element_totals(records: DataFrame, record: str = "record") -> DataFrame:
    """total_communes, total_provinces, skipped."""
    r = F.col(record)
    return records.agg(F.count_if(r["skipped"].isNull()).alias("total_communes"), F.count_distinct(r["province_code"]).alias("total_provinces"), F.count_if(r["skipped"].isNotNull()).alias("skipped"))


# ---- pages to snapshots ----


def units_of(page: Column) -> Column:
    """The unit records of a decoded page: the first of each ward code, by ward_order."""

    def read(s: Column) -> Column:
        g = lambda i: F.regexp_extract(s, UNIT, i)
        return F.struct(g(1).cast("int").alias("ward_order"), g(2).alias("ward_name"), g(3).alias("ward_code"), g(4).alias("ward_type"), g(5).alias("admin_center"), g(6).alias("merger_from"), g(8).alias("population"), g(9).alias("area"), g(10).alias("ward_slug"), g(12).alias("old_district"))

    def finish(u: Column) -> Column:
        population, area = numeric.parse_numeric(u["population"]), numeric.parse_numeric(u["area"])
        null = text.blank_as_null
        return F.struct(
            u["ward_order"].alias("ward_order"), u["ward_name"].alias("ward_name"), u["ward_code"].alias("ward_code"), u["ward_type"].alias("ward_type"),
            null(u["admin_center"]).alias("admin_center"), null(u["merger_from"]).alias("merger_from"), population.alias("population"), area.alias("area_km2"),
            numeric.density(population, area).alias("density_per_km2"), u["ward_slug"].alias("ward_slug"), null(u["old_district"]).alias("old_district"),
        )

    def first_of_code(found: Column) -> Column:
        """found is sorted by code, then place: a code's first record follows another code's."""
        return F.filter(found, lambda x, i: ~F.get(found, i - 1)["code"].eqNullSafe(x["code"]))

    def placed(x: Column) -> Column:
        return lookup.let(read(x["record"]), lambda u: F.struct(u["ward_order"].alias("ward_order"), x["at"].alias("at"), u.alias("u")))

    found = F.transform(F.regexp_extract_all(page, F.lit(UNIT), F.lit(0)), lambda s, i: F.struct(F.regexp_extract(s, _HEAD, 3).alias("code"), i.alias("at"), s.alias("record")))
    first = lookup.let(F.array_sort(found), first_of_code)
    return F.transform(F.array_sort(F.transform(first, placed)), lambda x: finish(x["u"]))


def summary_of(page: Column, slug: Column) -> Column:
    """The first embedded summary object of a decoded page whose short name is the slug, as VARIANT; null without one."""
    objects = F.transform(F.regexp_extract_all(page, F.lit(SUMMARY), F.lit(0)), F.try_parse_json)
    return F.get(F.filter(objects, lambda o: F.try_variant_get(o, "$.short_name", "string") == slug), F.lit(0))


def _texts(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "array<string>")


def summary_fields(doc: Column) -> Column:
    """The typed fields of a summary object."""
    get = lambda name: F.try_variant_get(doc, f"$.{name}", "string")
    number = lambda name: numeric.parse_numeric(get(name))
    none = F.array().cast("array<string>")
    codes = _texts(doc, "$.vehicle_license_codes")
    plates = F.when(codes.isNotNull(), F.filter(F.transform(codes, text.collapse_ends), lambda x: x != "")).otherwise(text.split_list(get("car_plate")))
    return F.struct(
        get("province_name").alias("province_name"), get("province_code").alias("province_code_text"), get("province_name_full").alias("province_name_full"),
        number("area").alias("area_km2"), number("population").alias("population"), get("administrative_center").alias("administrative_center"),
        get("phone_code").alias("phone_code"), get("region").alias("region"), get("economic_region").alias("economic_region"),
        number("total_ward").alias("total_ward"), number("total_commune").alias("total_commune"), number("total_unit").alias("total_unit"),
        F.coalesce(_texts(doc, "$.border_with_provinces"), none).alias("border_with_provinces"), get("border_description").alias("border_description"),
        get("border_with_country").alias("border_with_country"), get("has_sea").alias("has_sea"),
        F.coalesce(get("leader_bi_thu"), get("leader_secretary")).alias("secretary"), F.coalesce(get("leader_chu_tich"), get("leader_chairman")).alias("chairman"),
        number("grdp_billion_vnd").alias("grdp_billion_vnd"), number("per_capita_million_vnd").alias("income_per_capita_million_vnd"), number("revenue_billion_vnd").alias("revenue_billion_vnd"),
        plates.alias("vehicle_plates"),
    )


def vehicle_plates(page: Column) -> Column:
    """The plates that a page's narrative names."""
    return text.split_list(text.first_match(page, PLATES))


def snapshot(html: Column, name: Column, slug: Column, source: Column) -> Column:
    """The snapshot of a province's page: fields of its summary object, else of its narrative. Where no summary object is
    the slug's, `error` says so and the rest is null."""

    def read(x: Column) -> Column:
        page, s = x["page"], x["summary"]
        figure = lambda label: numeric.parse_numeric(text.first_match(page, FIGURE.format(label)))
        update = text.first_match(page, UPDATE)
        fields = {
            "province_name": name,
            "province_name_full": s["province_name_full"],
            "source_slug": slug,
            "hero_image_url": text.meta_content(html, "og:image"),
            "hero_image_alt": text.meta_content(html, "og:image:alt"),
            "province_code_text": s["province_code_text"],
            "administrative_center": s["administrative_center"],
            "phone_code": s["phone_code"],
            "vehicle_plates": F.when(F.size(s["vehicle_plates"]) > 0, s["vehicle_plates"]).otherwise(vehicle_plates(page)),
            "region": s["region"],
            "economic_region": s["economic_region"],
            "area_km2": s["area_km2"],
            "population": s["population"],
            "total_ward": s["total_ward"],
            "total_commune": s["total_commune"],
            "total_unit": s["total_unit"],
            "border_with_provinces": s["border_with_provinces"],
            "overview_summary": text.section_paragraph(page, F.concat(F.lit(OVERVIEW), s["province_name_full"])),
            "boundary_summary": F.coalesce(s["border_description"], text.section_paragraph(page, BOUNDARY)),
            "update_note": F.when(update != "", text.clean_html(update)),
            "secretary": F.coalesce(s["secretary"], text.first_match(page, SECRETARY)),
            "chairman": F.coalesce(s["chairman"], text.first_match(page, CHAIRMAN)),
            "grdp_billion_vnd": F.coalesce(s["grdp_billion_vnd"], figure("GRDP")),
            "income_per_capita_million_vnd": F.coalesce(s["income_per_capita_million_vnd"], figure("Thu nhập BQ")),
            "revenue_billion_vnd": F.coalesce(s["revenue_billion_vnd"], figure("Doanh thu")),
            "units": units_of(page),
            "source": source,
        }
        found = s["province_name"].isNotNull()
        error = F.when(~F.coalesce(found, F.lit(False)), F.concat(F.lit("no summary for "), slug))
        return F.struct(error.alias("error"), *[F.when(found, v).alias(k) for k, v in fields.items()])

    def with_summary(page: Column) -> Column:
        return lookup.let(F.struct(page.alias("page"), summary_fields(summary_of(page, slug)).alias("summary")), read)

    return lookup.let(text.unescape_quotes(html), with_summary)


def crawl_requests(documents: DataFrame, base: str) -> DataFrame:
    """file_name, province_name, source_slug, url of documents (file_name, doc); the job fails on one without a name."""
    name = F.try_variant_get("doc", "$.name.value", "string")
    named = F.when(F.coalesce(name, F.lit("")) != "", name).otherwise(F.raise_error(F.concat(F.lit("missing province name in "), "file_name")))
    return documents.select("file_name", named.alias("province_name")).withColumn("source_slug", text.slugify(F.col("province_name"))).withColumn("url", F.concat(F.lit(base + "/province/"), F.url_encode("source_slug")))
