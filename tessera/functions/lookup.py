"""Lookups in the reference tables as expressions: Column in, Column out.

The tables have a fixed size (34 provinces, 12 communes, 30 and 5 legacy names, 6 zones), so they are literals of the
expression: chains of conditions in list order, where the first that holds decides, and maps by normalised name. A
lookup joins and shuffles nothing, keeps repeated rows, and sees no column of the caller but its arguments.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import admin_key, normalize_admin_name
from tessera.sources import seeds

PROVINCE = {p[0]: (f"p-{i:03d}", *p, d) for i, (p, d) in enumerate(zip(seeds.PROVINCES, seeds.DESCRIPTIONS, strict=True), 1)}
COMMUNE = {c[0]: c for c in seeds.COMMUNES}
ZONE_FIELDS = ["current_commune", "current_province", "legacy_commune", "legacy_district", "legacy_province"]


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_case(cases: list[tuple[Column, object]]) -> Column:
    """The value of the first condition that holds, or null."""
    return reduce(lambda chain, c: chain.when(*c), cases[1:], F.when(*cases[0]))


def by_key(table: dict[str, object], key: Column) -> Column:
    """The entry of a literal map, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) if not isinstance(x, Column) else x for kv in table.items() for x in kv]), key)


def in_box(lat: Column, lon: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def province_at(lat: Column, lon: Column) -> Column:
    """Code of the first province whose box holds the point; edges are inside."""
    return first_case([(in_box(lat, lon, *p[4:]), p[0]) for p in seeds.PROVINCES])


def commune_at(lat: Column, lon: Column, province: Column) -> Column:
    """Code of the first commune of the province whose box holds the point."""
    return first_case([((province == c[4]) & in_box(lat, lon, *c[6:]), c[1]) for c in seeds.strips()])


def zone_at(lat: Column, lon: Column) -> Column:
    """Name of the first recorded zone that holds the point."""
    return first_case([(lat.between(z[1], z[2]) & lon.between(z[3], z[4]), z[0]) for z in seeds.ZONES])


def zone_field(zone: Column, field: str) -> Column:
    at = 5 + ZONE_FIELDS.index(field)
    return by_key({z[0]: z[at] for z in seeds.ZONES}, zone)


def province_keys() -> dict[str, str]:
    """Province code by normalised name: legacy names before names and aliases, the first of each."""
    out: dict[str, str] = {}
    for name, code in seeds.LEGACY_PROVINCES:
        out.setdefault(admin_key(name), code)
    for p in seeds.PROVINCES:
        for name in (p[1], *p[3]):
            out.setdefault(admin_key(name), p[0])
    return out


def province_of_name(name: Column) -> Column:
    """Code of the province that a current, former or other name means."""
    return by_key(province_keys(), normalize_admin_name(name))


def province_fact(code: Column, field: str) -> Column:
    """province_id, province_name, province_kind or description of a province code."""
    at = {"province_id": 0, "province_name": 2, "province_kind": 3, "description": 9}[field]
    return by_key({k: v[at] for k, v in PROVINCE.items()}, code)


def commune_fact(code: Column, field: str) -> Column:
    """commune_name, commune_type or province_code of a commune code."""
    at = {"commune_name": 1, "commune_type": 2, "province_code": 3}[field]
    return by_key({k: v[at] for k, v in COMMUNE.items()}, code)


def commune_count(province: Column) -> Column:
    counts = {code: sum(c[3] == code for c in seeds.COMMUNES) for code in PROVINCE}
    return by_key(counts, province)


# Reasons of alternatives and explanations, by the step of the name ladder that gave them.
EXPLANATION = {
    "skipped": "Không xác định được tỉnh/thành hiện tại nên bỏ qua bước tra cứu xã/phường.",
    "no_candidates": "Chưa có dữ liệu xã/phường hiện tại cho tỉnh/thành đã xác định.",
    "exact": "Khớp duy nhất theo tên xã/phường hiện tại sau khi chuẩn hóa trong phạm vi tỉnh/thành đã xác định.",
    "exact_many": "Có nhiều xã/phường hiện tại cùng khớp tên trong tỉnh/thành đã xác định.",
    "alias": "Khớp duy nhất theo alias xã/phường hiện tại trong phạm vi tỉnh/thành đã xác định.",
    "alias_many": "Có nhiều xã/phường hiện tại cùng khớp alias trong tỉnh/thành đã xác định.",
    "fuzzy": "Khớp duy nhất theo so khớp mờ trong phạm vi tỉnh/thành đã xác định.",
    "fuzzy_many": "Có nhiều ứng viên xã/phường khớp mờ nên không thể trả về kết quả duy nhất.",
    "none": "Không tìm thấy tên xã/phường hiện tại khớp trong phạm vi tỉnh/thành đã xác định.",
}
REASON = {
    "exact_many": "Trùng nhiều xã/phường hiện tại sau chuẩn hóa",
    "alias_many": "Nhiều alias cùng khớp trong tỉnh/thành đã xác định",
    "fuzzy_many": "Khớp mờ tên xã/phường",
    "none": "Không tìm thấy khớp duy nhất, hiển thị các xã/phường mẫu trong tỉnh/thành",
}
_CANDIDATE = "array<struct<code:string,name:string,type:string,province:string,norm:string,aliases:array<string>>>"
_ALTERNATIVE = "array<struct<commune_code:string,commune_name:string,commune_type:string,province_code:string,reason:string>>"


def _candidates(province: Column) -> Column:
    """The communes of a province in list order, with normalised names."""
    own: dict[str, list[Column]] = {}
    for code, name, kind, p, aliases in seeds.COMMUNES:
        norms = F.array(*[F.lit(k) for k in dict.fromkeys(admin_key(a) for a in (name, *aliases))])
        fields = {"code": F.lit(code), "name": F.lit(name), "type": F.lit(kind), "province": F.lit(p), "norm": F.lit(admin_key(name)), "aliases": norms}
        own.setdefault(p, []).append(F.struct(*[v.alias(k) for k, v in fields.items()]))
    return F.coalesce(by_key({p: F.array(*c) for p, c in own.items()}, province), F.array().cast(_CANDIDATE))


def commune_ladder(province: Column, name: Column) -> Column:
    """step, tier, match (a code, if one commune alone fits) and alternatives of a commune's name in a province.

    Exact names, then aliases, then names of which one holds the other. The first of these that finds any commune
    decides: one is the match, more are alternatives. Where none does, the province's first three are alternatives."""

    def decide(x: Column) -> Column:
        all_, n = x["all"], x["norm"]
        exact = F.filter(all_, lambda c: c["norm"] == n)
        alias = F.filter(all_, lambda c: F.array_contains(c["aliases"], n))
        fuzzy = F.filter(all_, lambda c: (n != "") & (F.contains(c["norm"], n) | F.contains(n, c["norm"])))
        found = F.when(F.size(exact) > 0, F.struct(F.lit("exact").alias("tier"), exact.alias("hits"))).when(F.size(alias) > 0, F.struct(F.lit("alias").alias("tier"), alias.alias("hits"))).when(F.size(fuzzy) > 0, F.struct(F.lit("fuzzy").alias("tier"), fuzzy.alias("hits"))).otherwise(F.struct(F.lit("none").alias("tier"), F.slice(all_, 1, 3).alias("hits")))
        return let(F.struct(x["province"].alias("province"), F.size(all_).alias("n"), found.alias("found")), finish)

    def finish(x: Column) -> Column:
        hits, tier = x["found"]["hits"], F.when(x["province"].isNull(), "skipped").when(x["n"] == 0, "no_candidates").otherwise(x["found"]["tier"])
        named = tier.isin("exact", "alias", "fuzzy")
        step = F.when(named & (F.size(hits) > 1), F.concat(tier, F.lit("_many"))).otherwise(tier)
        reason = by_key(REASON, step)
        other = F.transform(hits, lambda c: F.struct(c["code"].alias("commune_code"), c["name"].alias("commune_name"), c["type"].alias("commune_type"), c["province"].alias("province_code"), reason.alias("reason")))
        return F.struct(
            step.alias("step"),
            tier.alias("tier"),
            F.when(named & (F.size(hits) == 1), F.get(hits, F.lit(0))["code"]).alias("match"),
            F.when(reason.isNotNull(), other).otherwise(F.array()).cast(_ALTERNATIVE).alias("alternatives"),
        )

    return let(F.struct(province.alias("province"), _candidates(province).alias("all"), normalize_admin_name(name).alias("norm")), decide)


def legacy_crosswalk(commune: Column, district: Column, province: Column) -> Column:
    """Code of the current commune of the first default mapping of a legacy name. A district or province that is missing
    on either side fits any."""

    def fits(given: Column, raw: Column, own: str | None) -> Column:
        return F.lit(True) if not own else (F.coalesce(raw, F.lit("")) == "") | (given == admin_key(own))

    def decide(x: Column) -> Column:
        rows = [(c, d, p, code) for c, d, p, code, _, default in seeds.LEGACY_COMMUNES if default]
        return first_case([((x["raw_c"] != "") & (x["c"] == admin_key(c)) & fits(x["d"], x["raw_d"], d) & fits(x["p"], x["raw_p"], p), code) for c, d, p, code in rows])

    n = normalize_admin_name
    return let(F.struct(commune.alias("raw_c"), district.alias("raw_d"), province.alias("raw_p"), n(commune).alias("c"), n(district).alias("d"), n(province).alias("p")), decide)
