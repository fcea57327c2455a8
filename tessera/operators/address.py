"""Addresses: terms to parts, and the old and new reading of a request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import WHITE, blank_as_null, trimmed_input

COMMUNE = rf"(?iu)^(phường|xã|thị trấn){WHITE}+"
PROVINCE = rf"(?iu)^(tỉnh|thành phố){WHITE}+"
DISTRICT = rf"(?iu)^(quận|huyện|thị xã|thành phố){WHITE}+"


def parts(terms: Column) -> Column:
    """commune, district, province of an array of terms. A term that reads as a province is never a district; of
    several, the first `tỉnh`, else the last, is the province."""
    like = F.filter(terms, lambda x: x.rlike(PROVINCE))
    return F.struct(
        F.get(F.filter(terms, lambda x: x.rlike(COMMUNE)), F.lit(0)).alias("commune"),
        F.get(F.filter(terms, lambda x: x.rlike(DISTRICT) & ~x.rlike(PROVINCE)), F.lit(0)).alias("district"),
        F.coalesce(F.get(F.filter(like, lambda x: x.rlike(rf"(?iu)^tỉnh{WHITE}+")), F.lit(0)), F.get(like, F.size(like) - 1)).alias("province"),
    )


def split_terms(address: Column) -> Column:
    return F.filter(F.transform(F.split(address, ","), lambda x: F.trim(x)), lambda x: x != "")


def old_and_new(requests: DataFrame, old: DataFrame, new: DataFrame, key: str = "request_id") -> DataFrame:
    """Full join of the predictions of both services: key, old_*, new_*, found. A missing old reading echoes the
    request's parts, a missing new one is null; requests without either are left out."""
    fields = ["commune", "district", "province", "formatted"]
    o = old.select(key, F.lit(True).alias("has_old"), *[F.col(f).alias(f"o_{f}") for f in fields])
    n = new.select(key, F.lit(True).alias("has_new"), *[F.col(f).alias(f"n_{f}") for f in fields])
    both = requests.join(o.join(n, key, "full"), key)
    return both.select(
        key,
        *[F.when(F.col("has_old"), F.col(f"o_{f}")).otherwise(F.col(f"echo_{f}")).alias(f"old_{f}") for f in fields],
        *[F.when(F.col("has_new"), F.col(f"n_{f}")).otherwise(F.lit("" if f == "formatted" else None)).alias(f"new_{f}") for f in fields],
        (F.coalesce(F.col("has_new"), F.lit(False)) & (F.coalesce("n_province", F.lit("")) != "")).alias("found"),
    )


# Messages of address requests.
NO_KEY = "Dịch vụ bản đồ chưa được cấu hình."
NO_INPUT = "Vui lòng nhập địa chỉ hoặc tỉnh/thành trước sắp xếp."
NOT_FOUND = "Không tìm thấy địa chỉ phù hợp."


def request(address_text: Column, commune: Column, district: Column, province: Column, configured: Column | bool = True) -> Column:
    """What a request asks: mode (text, fields, or null with the status that refuses it), the query, and the parts that
    are echoed where the old structure is not found. Free text comes before fields."""
    text, c, d, p = (trimmed_input(x) for x in (address_text, commune, district, province))
    configured = F.lit(configured) if isinstance(configured, bool) else configured
    mode = F.when(~configured, None).when(text != "", "text").when(p != "", "fields")
    fields = F.concat_ws(" ", *[blank_as_null(x) for x in (c, d, p)])
    by_fields = mode == "fields"
    query = F.when(mode == "text", text).when(by_fields, fields)
    echo = F.struct(F.when(by_fields, c).alias("commune"), F.when(by_fields, d).alias("district"), F.when(by_fields, p).alias("province"), query.alias("formatted"))
    status = F.when(~configured, 503).when(mode.isNull(), 400)
    return F.struct(mode.alias("mode"), query.alias("query"), echo.alias("echo"), status.alias("status"))


def answer(asked: Column, old: Column, new: Column) -> Column:
    """The answer to a request from the first predictions (description and terms, or null) of the old and the new
    structure: status, message, old_address, new_address, found."""

    def address(prediction: Column, otherwise: Column) -> Column:
        own = parts(prediction["terms"])
        return F.when(prediction.isNotNull(), F.struct(own["commune"].alias("commune"), own["district"].alias("district"), own["province"].alias("province"), prediction["description"].alias("formatted"))).otherwise(otherwise)

    none = F.lit(None).cast("string")
    empty = F.struct(none.alias("commune"), none.alias("district"), none.alias("province"), F.lit("").alias("formatted"))
    status = F.coalesce(asked["status"], F.when(old.isNull() & new.isNull(), 404), F.lit(200))
    shown = status == 200
    fresh = address(new, empty)
    message = F.when(status == 503, NO_KEY).when(status == 400, NO_INPUT).when(status == 404, NOT_FOUND)
    return F.struct(
        status.alias("status"),
        message.alias("message"),
        F.when(shown, address(old, asked["echo"])).alias("old_address"),
        F.when(shown, fresh).alias("new_address"),
        F.when(shown, new.isNotNull() & (F.coalesce(fresh["province"], F.lit("")) != "")).alias("found"),
    )
