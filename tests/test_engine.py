import duckdb
import pytest
from pyspark.sql import functions as F

from tessera import catalogue, catalogue_etl, plans  # noqa: F401
from tessera.functions import lookup, numeric, text
from tessera.operators import address, profile, resolve
from tessera.sources import seeds

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sorted_rows(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = ",".join(sorted(df.columns))
    want = duck.execute(f"SELECT {columns} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()
    assert sorted_rows(df.select(*sorted(df.columns)).collect()) == sorted_rows(want)


@pytest.mark.parametrize(
    ("raw", "want"),
    [(None, ""), ("", ""), ("TP. Hồ Chí Minh", "ho chi minh"), ("Thị xã Hương Thủy", "huong thuy"), ("Bà Rịa - Vũng Tàu", "ba ria vung tau"), ("Quận 1", "1"), ("Phường 1", "1"), ("Tỉnh Xã X", "x"), ("Xã Tỉnh X", "tinh x"), ("Thị trấn Phường 1", "phuong 1"), ("tinh", "tinh"), ("Đặc khu Phú Quốc", "phu quoc")],
)
def test_admin_name(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(text.normalize_admin_name(F.col("x"))).first()[0] == want


def test_numbers(spark):
    df = spark.createDataFrame([(n[0],) for n in catalogue.NUMBERS], "x string")
    got = df.select(numeric.parse_numeric(F.col("x")), numeric.parse_numeric(F.col("x"), True)).collect()
    assert [tuple(r) for r in got] == [n[1:] for n in catalogue.NUMBERS]


# Latitude, longitude, province, commune, confidence, crosswalk, conflict.
GOLDEN = [
    (10.7769, 106.7009, "ho-chi-minh-city", "hcm-ben-thanh", "high", False, False),
    (10.97, 106.735, "ho-chi-minh-city", "hcm-thu-duc", "high", False, False),
    (16.05, 108.24, "da-nang", "da-nang-hai-chau", "high", False, False),
    (10.025, 105.79, "dong-thap", "can-tho-ninh-kieu", "medium", True, True),
    (20.2, 107.0, "hai-phong", "hai-phong-hong-bang", "medium", False, False),
    (9.9, 105.03, "can-tho", "can-tho-phong-dien", "medium", False, False),
    (10.65, 105.5, "tay-ninh", None, "low", False, False),
    (21.12, 105.5, "hanoi", "hanoi-ba-dinh", "medium", False, False),
    (0.0, 0.0, None, None, "low", False, False),
    (95.0, 106.0, None, None, "error", False, False),
]


def test_resolver(spark):
    points = spark.createDataFrame([(i, g[0], g[1]) for i, g in enumerate(GOLDEN)], "id int, lat double, lon double")
    got = {r.id: r for r in resolve.flat(resolve.resolve(points)).collect()}
    for i, g in enumerate(GOLDEN):
        r = got[i]
        assert (r.province_code, r.commune_code, r.confidence, r.crosswalk_used, r.conflict) == g[2:], g


def test_ladder(spark):
    asked = [("ho-chi-minh-city", "phường Bến Thành", "exact", "hcm-ben-thanh", 0), ("ho-chi-minh-city", "Phú Hòa", "alias", "hcm-thu-duc", 0), ("da-nang", "Hải", "fuzzy", "da-nang-hai-chau", 0), ("hue", "Phú Hội Hương Thủy", "fuzzy", None, 2), ("can-tho", "Xyz", "none", None, 2), ("hai-phong", None, "none", None, 2), ("gia-lai", "X", "no_candidates", None, 0), (None, "X", "skipped", None, 0)]
    df = spark.createDataFrame([(i, a[0], a[1]) for i, a in enumerate(asked)], "id int, p string, n string")
    got = {r.id: r.x for r in df.select("id", lookup.commune_ladder(F.col("p"), F.col("n")).alias("x")).collect()}
    assert [(got[i].tier, got[i].match, len(got[i].alternatives)) for i in range(len(asked))] == [a[2:] for a in asked]


def test_seed_checks_and_profiles(spark, tmp_path):
    assert seeds.checked_provinces(spark).count() == 34
    (tmp_path / "HaNoi.json").write_text('﻿{"population": {"total": {"value": 8435700}}, "location": {"latitude": {"value": "21,02"}}, "infrastructure": {"seaport": {"value": ["a"]}}}')
    (tmp_path / "CaMau.json").write_text("{bad")
    got = {r.name_key: r for r in profile.profile(profile.read_documents(spark, str(tmp_path))).collect()}
    assert got["ha noi"].population == 8435700 and got["ha noi"].latitude == 21.02 and got["ha noi"].infrastructure == ["a"]
    assert not got["ca mau"].has_profile and got["ca mau"].population is None


def test_address_without_terms(spark):
    df = spark.createDataFrame([("",), (None,)], "a string")
    assert [tuple(r[0] or (None,) * 3) for r in df.select(address.parts(address.split_terms(F.col("a")))).collect()] == [(None,) * 3] * 2
