"""Recorded answers of geocoding services, and the bundles of candidates that they give.

A service is a table of recorded answers (key, payload text, error); nothing here calls out. Payloads are JSON, read as
VARIANT. A bundle is a struct of a current and a legacy candidate: formatted_address, commune, district, province,
provider_name, payload.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.lookup import let
from tessera.functions.text import blank_as_null, first_non_blank, name_matches
from tessera.operators.address import parts
from tessera.operators.resolve import free_name, recorded_zone, resolution

CANDIDATE = "struct<formatted_address:string,commune:string,district:string,province:string,provider_name:string,payload:string>"
#: What is recorded where a call failed without a message.
UNKNOWN_REASON = "Không rõ nguyên nhân"


def candidate(formatted: Column, commune: Column, district: Column, province: Column, provider: Column, payload: Column) -> Column:
    return F.struct(formatted.alias("formatted_address"), commune.alias("commune"), district.alias("district"), province.alias("province"), provider.alias("provider_name"), payload.alias("payload"))


def bundle(current: Column, legacy: Column | None = None) -> Column:
    return F.struct(current.cast(CANDIDATE).alias("current"), (F.lit(None) if legacy is None else legacy).cast(CANDIDATE).alias("legacy"))


def text_at(doc: Column, path: str) -> Column:
    """A string leaf; null if absent or of another type."""
    return F.when(F.schema_of_variant(F.try_variant_get(doc, path, "variant")) == "STRING", F.try_variant_get(doc, path, "string"))


def json_error(doc: Column, payload: Column, error: Column) -> Column:
    """What a failed call says: its recorded error, or an error field in the answer."""
    own = text_at(doc, "$.error")
    return F.coalesce(error, F.when(payload.isNull() | doc.isNull(), UNKNOWN_REASON), F.when(own != "", F.concat(F.lit("Dịch vụ bản đồ trả về lỗi: "), own)))


def address_bundle(payload: Column, provider: str = "nominatim") -> Column:
    """Bundle from an answer with an `address` object: finer names before coarser ones; there is no legacy candidate."""

    def read(doc: Column) -> Column:
        first = lambda *names: F.coalesce(*[text_at(doc, f"$.address.{n}") for n in names])
        return bundle(
            candidate(
                F.coalesce(text_at(doc, "$.display_name"), F.lit("")),
                first("quarter", "suburb", "village", "neighbourhood", "hamlet"),
                first("city_district", "district", "county"),
                first("city", "town", "state"),
                F.lit(provider),
                payload,
            )
        )

    return let(F.try_parse_json(payload), read)


def components(doc: Column) -> Column:
    """long_name, short_name and types of the first result's address components that have a long name."""
    raw = F.coalesce(F.try_variant_get(doc, "$.results[0].address_components", "array<variant>"), F.array().cast("array<variant>"))

    def one(c: Column) -> Column:
        long = first_non_blank(text_at(c, "$.long_name"))
        types = F.coalesce(F.try_variant_get(c, "$.types", "array<variant>"), F.array().cast("array<variant>"))
        names = F.filter(F.transform(types, lambda t: text_at(t, "$")), lambda t: t.isNotNull())
        return F.struct(long.alias("long_name"), F.coalesce(first_non_blank(text_at(c, "$.short_name")), long).alias("short_name"), names.alias("types"))

    return F.filter(F.transform(raw, one), lambda c: c["long_name"].isNotNull())


def find_by_type(parts_: Column, *types: str) -> Column:
    """long_name of the first component of the first type that any has."""
    def first(kind: str) -> Column:
        return F.get(F.filter(parts_, lambda c: F.array_contains(c["types"], kind)), F.lit(0))["long_name"]

    return F.coalesce(*[first(t) for t in types])


def first_prediction(payload: Column, error: Column | None = None) -> Column:
    """description and terms of the first prediction of an autocomplete answer; null for a failed or empty one."""
    doc = F.try_parse_json(payload)
    terms = F.transform(F.try_variant_get(doc, "$.predictions[0].terms", "array<variant>"), lambda t: text_at(t, "$.value"))
    found = F.try_variant_get(doc, "$.predictions[0]", "variant")
    sound = found.isNotNull() if error is None else found.isNotNull() & error.isNull()
    return F.when(sound, F.struct(F.coalesce(text_at(doc, "$.predictions[0].description"), F.lit("")).alias("description"), F.coalesce(terms, F.array().cast("array<string>")).alias("terms")))


def component_bundle(payload: Column, prediction: Column, division: Column | None = None, provider: str = "openmap") -> Column:
    """Bundle from an answer with address components, the autocomplete prediction for its address in the new structure
    (description and terms, or null), and the chain of former divisions (province, district and ward names, or null)."""

    def read(x: Column) -> Column:
        doc, c, new = x["doc"], x["components"], x["prediction"]
        full = F.coalesce(first_non_blank(text_at(doc, "$.results[0].formatted_address"), text_at(doc, "$.formatted_address")), F.lit(""))
        commune = find_by_type(c, "sublocality_level_1", "sublocality", "administrative_area_level_3")
        province = find_by_type(c, "administrative_area_level_1", "locality")
        district = find_by_type(c, "administrative_area_level_2")
        # A prediction is asked for only where there is an address.
        named = F.when(full != "", new)
        own = parts(named["terms"])
        joined = lambda *names: F.concat_ws(", ", *[blank_as_null(n) for n in names])
        current = candidate(
            F.when(named.isNull(), joined(commune, province)).otherwise(named["description"]),
            F.coalesce(own["commune"], commune),
            F.lit(None),
            F.coalesce(own["province"], province),
            F.when(named.isNull(), provider).otherwise(f"{provider}-admin-v2"),
            payload,
        ).cast(CANDIDATE)
        legacy = F.when(full != "", candidate(full, commune, district, province, F.lit(f"{provider}-legacy-derived"), payload).cast(CANDIDATE))
        if division is not None:
            d = x["division"]
            ward, area, whole = F.coalesce(d["ward"], commune), F.coalesce(d["district"], district), F.coalesce(d["province"], province)
            enriched = candidate(joined(ward, area, whole), ward, area, whole, F.lit("openmap+open-api-vn"), F.to_json(d)).cast(CANDIDATE)
            legacy = F.when(district.isNotNull() & d.isNotNull(), enriched).otherwise(legacy)
        return F.struct(current.alias("current"), legacy.alias("legacy"))

    start = F.struct(F.try_parse_json(payload).alias("doc"), components(F.try_parse_json(payload)).alias("components"), prediction.alias("prediction"), *([division.alias("division")] if division is not None else []))
    return let(start, read)


def with_fallback(primary: Column, primary_error: Column, secondary: Column) -> Column:
    """The primary's bundle, or after an error the secondary's; and the error as fallback_reason."""
    failed = primary_error.isNotNull()
    reason = F.when(failed, F.coalesce(blank_as_null(primary_error), F.lit(UNKNOWN_REASON)))
    return F.struct(F.when(failed, secondary).otherwise(primary).alias("bundle"), reason.alias("fallback_reason"))


def _level(asked: DataFrame, key: str, name: str, parent: str | None, divisions: DataFrame, level: str, out: str) -> DataFrame:
    """asked with the code and name of the division that a name means, among the recorded answers to it.

    Of the answers to a name those under the parent, or all where none is, and of these the first that matches by name,
    or the first. Equal questions are looked up once."""
    own = divisions.where(F.col("level") == level).select(F.col("query").alias("_q"), F.struct("ord", "code", "name", "parent_code").alias("_d"))
    answers = own.groupBy("_q").agg(F.transform(F.array_sort(F.collect_list("_d")), lambda d: d).alias("_answers"))
    questions = asked.select(F.col(name).alias("_n")).where("_n <> ''").distinct()
    known = questions.join(answers, F.col("_n") == F.col("_q"), "left").select("_n", "_answers")
    joined = asked.join(known, F.col(name) == F.col("_n"), "left")

    def choose(a: Column) -> Column:
        under = F.filter(a, lambda d: d["parent_code"] == F.col(parent)["code"]) if parent else a
        pool = F.when(F.size(under) > 0, under).otherwise(a)
        best = F.get(F.filter(pool, lambda d: name_matches(d["name"], F.col(name))), F.lit(0))
        return F.coalesce(best, F.get(pool, F.lit(0)))

    found = choose(F.col("_answers"))
    return joined.withColumn(out, F.when(found.isNotNull(), F.struct(found["code"].alias("code"), found["name"].alias("name")))).drop("_n", "_answers")


def division_chain(asked: DataFrame, divisions: DataFrame, province: str = "province", district: str = "district", ward: str = "ward", out: str = "division") -> DataFrame:
    """asked with the former province, district and ward (code and name) that its names mean, each within the one above.

    divisions: level (p, d, w), query, ord, code, name, parent_code: recorded answers to a search, in order."""
    rows = asked.select(F.struct("*").alias("_row"), F.col(province).alias("_p"), F.col(district).alias("_d0"), F.col(ward).alias("_w"))
    rows = _level(rows, "_row", "_p", None, divisions, "p", "_province")
    rows = _level(rows, "_row", "_d0", "_province", divisions, "d", "_district")
    rows = _level(rows, "_row", "_w", "_district", divisions, "w", "_ward")
    return rows.select("_row.*", F.struct(F.col("_province").alias("province"), F.col("_district").alias("district"), F.col("_ward").alias("ward")).alias(free_name(asked, out)))


def recorded(requests: DataFrame, answers: DataFrame, key: str, out: str) -> DataFrame:
    """requests with a service's recorded answer (payload, error) in the struct `out`, looked up by key; a request that
    was not recorded counts as failed."""
    own = answers.select(F.col(key).alias("_key"), F.struct("payload", "error").alias("_answer"))
    none = F.struct(F.lit(None).cast("string").alias("payload"), F.lit(UNKNOWN_REASON).alias("error"))
    rows = requests.select(F.struct("*").alias("_row"), F.col(key).alias("_k")).join(own, F.col("_k") == F.col("_key"), "left")
    return rows.select("_row.*", F.coalesce("_answer", none).alias(free_name(requests, out)))


class Provider:
    """A geocoding service: `name`, and `bundles` that gives points their answers.

    Subclass it for a live service, with a mapInPandas over the points inside `bundles`; the ones here are recorded."""

    name = "none"

    def bundles(self, points: DataFrame, key: str) -> DataFrame:
        """points with `bundle` (null after an error) and `error`, under names that points does not have."""
        raise NotImplementedError


def _answered(points: DataFrame, bundle_: Column, error: Column) -> DataFrame:
    return points.withColumns({free_name(points, "bundle"): bundle_, free_name(points, "error"): error})


class RecordedZones(Provider):
    """The zones' answers, by the columns lat and lon."""

    name = "mock"

    def bundles(self, points: DataFrame, key: str) -> DataFrame:
        return _answered(points, recorded_zone(F.col("lat"), F.col("lon")).cast(f"struct<current:{CANDIDATE},legacy:{CANDIDATE}>"), F.lit(None).cast("string"))


class RecordedAddresses(Provider):
    """Answers with an address object: key, payload, error."""

    name = "nominatim"

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def bundles(self, points: DataFrame, key: str) -> DataFrame:
        out = free_name(points, "_answer")
        rows = recorded(points, self.answers, key, out)
        a = F.col(out)
        failed = json_error(F.try_parse_json(a["payload"]), a["payload"], a["error"])
        return _answered(rows, F.when(failed.isNull(), address_bundle(a["payload"], self.name)), failed).drop(out)


class RecordedComponents(Provider):
    """Answers with address components, and the autocomplete answers for their addresses: key, payload, error each."""

    name = "openmap"

    def __init__(self, answers: DataFrame, predictions: DataFrame):
        self.answers, self.predictions = answers, predictions

    def bundles(self, points: DataFrame, key: str) -> DataFrame:
        first, second = free_name(points, "_answer"), free_name(points, "_prediction")
        rows = recorded(recorded(points, self.answers, key, first), self.predictions, key, second)
        a, p = F.col(first), F.col(second)
        failed = F.coalesce(a["error"], F.when(F.try_parse_json(a["payload"]).isNull(), UNKNOWN_REASON))
        return _answered(rows, F.when(failed.isNull(), component_bundle(a["payload"], first_prediction(p["payload"], p["error"]))), failed).drop(first, second)


class Fallback(Provider):
    """The primary's answer or, after an error, the secondary's with the reason in its current payload."""

    name = "openmap-with-fallback"

    def __init__(self, primary: Provider, secondary: Provider):
        self.primary, self.secondary = primary, secondary

    def bundles(self, points: DataFrame, key: str) -> DataFrame:
        row = free_name(points, "_row")
        one = self.primary.bundles(points, key)
        two = one.select(F.struct(*points.columns).alias(row), *points.columns, *[F.col(c).alias(f"_{i}") for i, c in enumerate(one.columns[len(points.columns) :])])
        both = self.secondary.bundles(two, key)
        b, e = both.columns[-2:]
        failed = F.col("_1").isNotNull()
        reasoned = F.col(b).withField("current.payload", F.to_json(F.struct(F.col(b)["current"]["payload"].alias("answer"), F.col("_1").alias("fallback_reason"))))
        return both.select(f"{row}.*", F.when(failed, reasoned).otherwise(F.col("_0")).alias(free_name(points, "bundle")), F.when(failed, F.col(e)).alias(free_name(points, "error")))


def resolve_with(provider: Provider, points: DataFrame, key: str, out: str = "resolution") -> DataFrame:
    """points resolved by a provider's answers; where it failed, `error` says why and the rest is null."""
    rows = provider.bundles(points, key)
    b, e = F.col(rows.columns[-2]), F.col(rows.columns[-1])
    r = resolution(F.col("lat"), F.col("lon"), b, provider.name)
    return rows.select(*points.columns, F.when(e.isNull(), r).otherwise(failure(r, e)).alias(free_name(points, out)))


def failure(like: Column, error: Column) -> Column:
    """A response that holds an error alone."""
    blank = like.withField("error", F.coalesce(like["error"], error))
    for field in ("normalized", "legacy_match", "current_match", "alternatives", "confidence", "resolution_path", "debug"):
        blank = blank.withField(field, F.when(F.lit(False), like[field]))
    return blank
