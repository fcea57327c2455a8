import time

import pytest
from pyspark.sql import functions as F

from tessera import catalogue_etl
from tessera.functions import text
from tessera.operators import etl

SHOWN = ["ward_order", "ward_name", "ward_code", "population", "area_km2", "density_per_km2"]


def record(order, name, code, population=1000, area=2):
    return (
        f'{{"id":1,"created_at":"x","ward_order":{order},"ward_name":"{name}","ward_code":"{code}","ward_type":"t","admin_center":"","merger_from":"","province_id_ref":1,"province_code":2,"province_name":"P",'
        f'"population":"{population}","area":{area},"longitude":1,"latitude":2,"ward_ref_code":3,"tree_code":4,"district":"","search_normalized":"s","ward_slug":"s","province_slug":"p","updated_at":"u","old_province_name":null,"old_province_slug":"x","old_district":"D"}}'
    )


def units(spark, page):
    found = spark.createDataFrame([(page,)], "page string").select(etl.units_of(F.col("page")).alias("u")).first()[0]
    return found if found is None else [tuple(u[c] for c in SHOWN) for u in found]


@pytest.mark.parametrize(("page", "want"), [(None, None), ("", []), ('<p>{"id":1}</p>', []), (record(3, "A", "x"), [(3, "A", "x", 1000.0, 2.0, 500.0)])])
def test_pages_with_few_records(spark, page, want):
    assert units(spark, page) == want


def test_first_record_of_a_code_by_order_then_place(spark):
    page = "<b>".join([record(2, "A", "b"), record(1, "B", "a", "1.500", 0), record(0, "C", "b"), record(1, "D", "A"), record(10, "E", "10"), record(2, "F", " b"), record(9, "G", "a"), record(9, "H", "9")])
    assert [u[:3] for u in units(spark, page)] == [(1, "B", "a"), (1, "D", "A"), (2, "A", "b"), (2, "F", " b"), (9, "H", "9"), (10, "E", "10")]
    assert units(spark, page)[0][3:] == (1500.0, 0.0, None)


def test_time_grows_with_the_records_of_a_page(spark):
    """Every record once looked at all codes of its page, with which this test took 98 s."""
    n = 20_000
    own = [(i * 7919 % 1000, f"w{i}", str(i * 31 % n // 2)) for i in range(n)]
    first = {}
    for i, (order, name, code) in enumerate(own):
        first.setdefault(code, (order, i, name, code))
    want = [(o, name, code) for o, _, name, code in sorted(first.values())]
    units(spark, record(1, "A", "x"))
    began = time.time()
    got = units(spark, ",".join(record(*r) for r in own))
    assert [u[:3] for u in got] == want and len(want) == n // 2
    assert time.time() - began < 10


def test_pages_hold_every_part(spark):
    sf_dir = "/root/testdata/sf0.001"
    page = text.unescape_quotes(F.col("html"))
    got = catalogue_etl._pages_of_units(spark, sf_dir).select("p_brand", F.regexp_extract_all(page, F.lit(etl.UNIT), F.lit(2)).alias("names")).collect()
    part = spark.read.parquet(f"{sf_dir}/part.parquet").orderBy("p_partkey").collect()
    assert {r.p_brand: r.names for r in got} == {b: [p.p_name for p in part if p.p_brand == b] for b in {p.p_brand for p in part}}
