import pytest
from pyspark.sql import functions as F

from tessera import catalogue, catalogue_etl, plans  # noqa: F401
from tessera.functions import geo, lookup, text
from tessera.operators import etl, knowledge, profile, provinces, resolve
from tessera.sources import files, seeds
from tessera.streaming.points import resolve_stream

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["point_province_bbox", "point_commune_strip", "zone_lookup_default", "commune_ladder", "legacy_commune_crosswalk", "province_crosswalk", "resolve_confidence", "resolve_response", "address_requests", "geocode_address", "geocode_components", "display_values"])
def test_no_shuffle_no_python(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    assert plans.exchanges(df) == 0 and plans.python_stages(df) == 0


def test_repeated_rows_and_clashing_names_stay(spark):
    names = ["zone", "ord", "resolution", "best", "province", "tier", "_row", "x"]
    df = spark.createDataFrame([(10.7769, 106.7009)] * 2 + [(95.0, 106.0), (None, 106.0), (float("nan"), 1.0), (10.0, 181.0)], "lat double, lon double").withColumns({n: F.lit("clash") for n in names})
    got = resolve.resolve(df)
    assert got.columns == [*df.columns, "resolution_"] and got.count() == 6
    assert [r["resolution_"].error for r in got.collect()] == [None, None, resolve.LAT_RANGE, resolve.BAD_LAT, resolve.BAD_LAT, resolve.LON_RANGE]
    flat = resolve.flat(got, "resolution_").collect()
    assert [(r.commune_code, r.commune_type, r.confidence) for r in flat] == [("hcm-ben-thanh", "phuong", "high")] * 2 + [(None, None, "error")] * 4
    detail = provinces.details(df.withColumn("code", F.lit("hue")), "code", *[spark.createDataFrame([], "key string, value string")] * 2)
    assert detail.count() == 6 and {r.status for r in detail.collect()} == {200}


def test_current_match_takes_the_commune_own_type(spark):
    bundle = lambda commune, legacy: F.struct(F.struct(F.lit("").alias("formatted_address"), F.lit(commune).cast("string").alias("commune"), F.lit(None).cast("string").alias("district"), F.lit("Đà Nẵng").alias("province"), F.lit("t").alias("provider_name"), F.lit("").alias("payload")).alias("current"), F.when(F.lit(legacy is not None), F.struct(F.lit("").alias("formatted_address"), F.lit(legacy).cast("string").alias("commune"), F.lit(None).cast("string").alias("district"), F.lit(None).cast("string").alias("province"), F.lit("t").alias("provider_name"), F.lit("").alias("payload"))).alias("legacy"))
    df = spark.createDataFrame([(0.0, 0.0)], "lat double, lon double")
    cases = {("đặc khu Hòa Vang", None): ("da-nang-hoa-vang", "xã Hòa Vang", "xa", "high"), ("đặc khu Xyz", None): (None, "đặc khu Xyz", "dac_khu", "medium"), (None, None): (None, None, None, "low"), ("", None): (None, "", None, "low"), ("xã Lạ", "Phường Hòa Hải"): ("da-nang-hai-chau", "phường Hải Châu", "phuong", "medium"), (None, "Phường Phú Hòa"): ("hcm-thu-duc", "phường Thủ Đức", "phuong", "low")}
    for (commune, legacy), want in cases.items():
        r = resolve.resolve(df, bundle(commune, legacy)).first().resolution
        m = r.current_match
        assert (m.commune_code, m.commune_name, m.commune_type, r.confidence) == want and m.province_code == "da-nang"
        assert ("legacy_commune_crosswalk" in r.resolution_path) == (legacy is not None) == r.debug.crosswalk_used


def test_html_functions(spark):
    cases = [
        (text.clean_html, "a<!-- c -->b", "a b"),
        (text.clean_html, "a &nbsp;<br />b<i>c</i>\n", "a b c"),
        (text.clean_html, "a<!-- c\nd -->b", "a b"),
        (lambda c: text.meta_content(c, "og:x"), '<meta name="og:x" content="n"><meta content="p" property="og:x">', "p"),
        (lambda c: text.meta_content(c, "og:x"), '<meta property="og:x" content=""><meta name="og:x" content=" n ">', "n"),
        (lambda c: text.meta_content(c, "og:x"), '<meta property="ogax" content="n">', None),
        (lambda c: text.section_paragraph(c, "H"), "<h3>H</h3> <p>a</p>", None),
        (lambda c: text.section_paragraph(c, "H"), "<h3>H</h3><p><b> </b></p>", ""),
        (lambda c: text.first_match(c, "x(.*)y"), "x  y", ""),
        (lambda c: text.infer_commune_type(c), "phường1", "xa"),
        (lambda c: text.infer_commune_type(c, True), "Một Phường", "phuong"),
        (text.vietnamize, "Hue City, TP. A", "Thành phố Hue, TP A"),
        (text.vietnamize, text.SOURCE_NOTE, text.SHOWN_NOTE),
        (text.strip_admin_prefix, "Thị trấn  Thị trấn A ", "Thị trấn A"),
        (text.normalize_admin_name, "ЁЖ Ά", "еж α"),
    ]
    for f, raw, want in cases:
        df = spark.createDataFrame([(raw,)], "x string")
        assert df.select(f(F.col("x"))).first()[0] == want, raw


def test_python_and_column_keys_agree(spark):
    raw = [p[1] for p in seeds.PROVINCES] + [a for p in seeds.PROVINCES for a in p[3]] + [n for n, _ in seeds.FORMER_NAMES] + ["TP. Hồ  Chí-Minh", "Xã Tỉnh X", "", "Đắk Lắk"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, x string")
    assert [r[1] for r in df.select("i", text.normalize_admin_name(F.col("x"))).orderBy("i").collect()] == [text.admin_key(r) for r in raw]


def test_checks_fail_on_wrong_seeds(spark):
    good = seeds.provinces(spark)
    bad = [good.limit(33), good.withColumn("province_name", F.when(F.col("ord") > 1, F.col("province_name"))), good.withColumn("west", F.when(F.col("ord") > 1, F.col("west")))]
    for rows in bad:
        with pytest.raises(ValueError, match="34"):
            seeds.checked_provinces(rows)
    communes = seeds.communes(spark)
    for rows in (communes.limit(0), communes.withColumn("province_code", F.lit(""))):
        with pytest.raises(ValueError, match="communes"):
            seeds.checked_communes(rows)
    features = good.withColumn("collection", F.lit("FeatureCollection"))
    assert seeds.checked_features(features).count() == 34
    for rows, n in ((features.limit(3), 34), (features.limit(0), None), (good.withColumn("collection", F.lit("Feature")), 34)):
        with pytest.raises(ValueError, match="Feature"):
            seeds.checked_features(rows, n)


def test_geojson_round_trip(spark, tmp_path):
    square = geo.ring(*[F.col(c) for c in ("west", "south", "east", "north")])
    parts = F.when(F.col("ord") % 2 == 0, F.array(F.array(square), F.array(square))).otherwise(F.array(F.array(square)))
    rows = seeds.provinces(spark).withColumn("geometry", parts)
    path = str(tmp_path / "provinces")
    files.write_text(files.collection_json(rows, ["province_id", "province_code", "province_name", "province_kind"], "ord"), path)
    got = files.province_features(spark, path)
    key = ["province_id", "province_code", "province_name", "province_kind", "geometry"]
    assert sorted(map(str, got.select(*key).collect())) == sorted(map(str, rows.select(*key).collect()))
    inside = got.where(geo.in_multipolygon(F.col("geometry"), F.lit(105.8), F.lit(21.05))).select("province_code").collect()
    assert [r[0] for r in inside] == ["hanoi"]
    files.write_text(files.collection_json(rows.limit(2), ["province_code"], "ord"), path)
    with pytest.raises(ValueError, match="34"):
        files.province_features(spark, path)


def test_elements_and_snapshots_from_files(spark, tmp_path):
    (tmp_path / "elements.json").write_text('{"elements":[{"tags":{"name:vi":"Phường A","name":"Ward A"},"center":{"lat":21.0,"lon":105.8}},{"tags":{"name":"Xã B"}},{"center":{"lat":1,"lon":1}},{"tags":{"name":"Xã C"},"center":{"lat":0,"lon":0}}]}')
    found = etl.element_records(files.read_elements(spark, str(tmp_path / "elements.json"))).orderBy("ord").collect()
    assert [(r.record.skipped, r.record.commune_code, r.record.commune_type) for r in found] == [(None, "hanoi-phuong-a", "phuong"), ("no_centre", None, None), ("no_name", None, None), ("no_province", None, None)]
    names = spark.createDataFrame([(n, 21.0, 105.8) for n in ("xã Ăn", "xã Đa", "xã An", "xã Du")], "name string, lat double, lon double").withColumn("name_vi", F.lit(None).cast("string"))
    own = etl.communes_by_province(etl.element_records(names)).collect()
    assert [(r.province_code, r.n, [c.commune_name for c in r.communes]) for r in own] == [("hanoi", 4, ["xã An", "xã Ăn", "xã Du", "xã Đa"])]

    snapshots = spark.createDataFrame([(2, "Huế"), (1, "An Giang")], "k int, province_name string").select("k", F.struct("province_name").alias("snapshot"))
    source = F.struct(F.lit("s").alias("name"), F.lit("u").alias("url"), F.lit("t").alias("terms_url"), F.lit("n").alias("note"))
    whole = files.snapshot_file(snapshots, text.normalize_key(F.col("snapshot.province_name")), text.iso_now(), source)
    files.write_text(whole, str(tmp_path / "snapshots"))
    back = files.read_snapshots(spark, str(tmp_path / "snapshots"), "struct<province_name:string>").orderBy("ord").collect()
    assert [r.snapshot.province_name for r in back] == ["An Giang", "Huế"] and back[0].generated_at.endswith("Z")
    (tmp_path / "broken.json").write_text('{"provinces": [')
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        files.read_snapshots(spark, str(tmp_path / "broken.json"), "struct<province_name:string>").collect()


def test_documents_in_and_out(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "01_HaNoi.json").write_text('﻿{"name":{"value":"Hà Nội"}}')
    (tmp_path / "in" / "02_Hue.json").write_text('{"name":{"value":""}}')
    (tmp_path / "in" / "notes.txt").write_text("x")
    docs = profile.read_documents(spark, str(tmp_path / "in"))
    assert sorted(r.file_name for r in docs.collect()) == ["01_HaNoi.json", "02_Hue.json"]
    asked = etl.crawl_requests(docs.where("file_name like '01%'"), "https://pages.example").first()
    assert (asked.province_name, asked.source_slug, asked.url) == ("Hà Nội", "ha-noi", "https://pages.example/province/ha-noi")
    with pytest.raises(Exception, match="missing province name in 02_Hue.json"):
        etl.crawl_requests(docs, "https://pages.example").collect()
    texts = spark.createDataFrame([("01_HaNoi.json", "{}")], "file_name string, doc string")
    for _ in range(2):
        files.write_documents(texts, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("file_name", "doc").collect()] == [("01_HaNoi.json", "{}")]
    files.write_table(texts, str(tmp_path / "table"), "file_name")
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1


def test_knowledge_folder(spark, tmp_path):
    folder = tmp_path / "kb"
    assert files.read_knowledge(spark, str(folder)).count() == 0 and folder.is_dir()
    (folder / "b.txt").write_text("hai")
    (folder / "a.pdf").write_bytes(b"PDF mot")
    (folder / "c.json").write_text("{}")
    parts = files.read_knowledge(spark, str(folder), lambda content: F.decode(content, "utf-8"))
    assert files.knowledge_base(parts).first()[0] == "\n\n--- TÀI LIỆU (PDF): a.pdf ---\nPDF mot\n\n--- TÀI LIỆU (TXT): b.txt ---\nhai"
    with pytest.raises(Exception, match="too large"):
        files.knowledge_base(parts, 10).collect()


def test_shown_snapshot(spark):
    df = spark.createDataFrame([("Hue City", text.SOURCE_NOTE), (None, None)], "c string, n string")
    snap = F.struct(F.col("c").alias("administrative_center"), F.struct(F.col("n").alias("note"), F.lit("u").alias("url")).alias("source"))
    got = [r[0] for r in df.select(provinces.shown_snapshot(snap)).collect()]
    assert [(s.administrative_center, s.source.note, s.source.url) for s in got] == [("Thành phố Hue", text.SHOWN_NOTE, "u"), (None, None, "u")]


def test_answers_that_are_not_sound(spark):
    answers = ["{bad", "{}", '{"tinh_hinh_rung":"a","tinh_hinh_bien":"b","o_nhiem_tong_hop":"c"}', None]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [r[0] is not None for r in df.select(knowledge.read_answer(F.col("a"))).collect()] == [False, False, True, False]


def test_stream_of_points(spark, tmp_path):
    spark.createDataFrame([(1, 10.7769, 106.7009), (1, 10.7769, 106.7009), (2, 95.0, 0.0)], "id int, lat double, lon double").write.parquet(str(tmp_path / "in"))
    points = spark.readStream.schema("id int, lat double, lon double").parquet(str(tmp_path / "in"))
    resolve_stream(points, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.id, r.confidence) for r in got) == [(1, "high"), (1, "high"), (2, "error")]


def test_stamps(spark):
    now, today = spark.range(1).select(text.iso_now(), text.iso_today()).first()
    assert now.startswith(today) and len(now) == 24 and len(today) == 10


def test_first_case_keeps_list_order(spark):
    df = spark.createDataFrame([(10.9, 106.9)], "lat double, lon double")
    boxes = [p[0] for p in seeds.PROVINCES if p[4] <= 106.9 <= p[6] and p[5] <= 10.9 <= p[7]]
    assert df.select(lookup.province_at(F.col("lat"), F.col("lon"))).first()[0] == boxes[0]


def test_refresh_by_versions(spark, tmp_path):
    from tessera.streaming.refresh import current, refresh

    sound = lambda x: '{"tinh_hinh_rung":"%s","tinh_hinh_bien":"b","o_nhiem_tong_hop":"c"}' % x
    base = spark.createDataFrame([("a.json", '{"k":1}'), ("b.json", '{"k":2}'), ("c.json", "{bad")], "file_name string, doc string")
    steps = [[(1, "a.json", sound("x")), (2, "a.json", sound("y")), (1, "b.json", "{}")], [(3, "b.json", sound("z")), (3, "c.json", sound("w"))]]
    for i, step in enumerate(steps):
        spark.createDataFrame(step, "at int, file_name string, answer string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("at int, file_name string, answer string").parquet(str(tmp_path / "in"))
        refresh(stream, base, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
        got = {r.file_name: r.doc for r in current(spark, str(tmp_path / "out"), base).collect()}
        assert '"y"' in got["a.json"] and ('"z"' in got["b.json"]) == (i == 1) and got["c.json"] == "{bad"
    assert {r.file_name: r.doc for r in current(spark, str(tmp_path / "none"), base).collect()}["a.json"] == '{"k":1}'


def test_providers(spark):
    from tessera.operators import geocode as g

    points = spark.createDataFrame([(i, 16.05, 108.24) for i in (1, 2, 2, 3, 4)], "id int, lat double, lon double").withColumns({"bundle": F.lit("clash"), "error": F.lit("clash")})
    component = '{"results":[{"formatted_address":"cũ","address_components":[{"long_name":"phường Hải Châu","types":["sublocality"]},{"long_name":"Đà Nẵng","types":["locality"]}]}]}'
    first = spark.createDataFrame([(1, component, None), (2, None, "HTTP 500"), (3, "{bad", None)], "id int, payload string, error string")
    second = spark.createDataFrame([(2, '{"display_name":"n","address":{"quarter":"xã Hòa Vang","city":"Huế"}}', None), (3, '{"error":"Unable"}', None)], "id int, payload string, error string")
    predictions = spark.createDataFrame([(1, '{"predictions":[]}', None)], "id int, payload string, error string")
    provider = g.Fallback(g.RecordedComponents(first, predictions), g.RecordedAddresses(second))
    rows = provider.bundles(points, "id").orderBy("id").collect()
    assert rows[0]["bundle_"].current.commune == "phường Hải Châu" and rows[0]["bundle_"].legacy.formatted_address == "cũ" and rows[0]["error_"] is None
    assert rows[1] == rows[2] and rows[1]["bundle_"].legacy is None and "HTTP 500" in rows[1]["bundle_"].current.payload
    assert rows[3]["error_"] == "Dịch vụ bản đồ trả về lỗi: Unable" and rows[4]["error_"] == g.UNKNOWN_REASON
    got = g.resolve_with(provider, points, "id").orderBy("id").collect()
    assert [r.resolution.error for r in got] == [None] * 3 + [rows[3]["error_"], rows[4]["error_"]]
    assert [r.resolution.current_match and r.resolution.current_match.commune_code for r in got] == ["da-nang-hai-chau", "da-nang-hoa-vang", "da-nang-hoa-vang", None, None]
    assert got[1].resolution.debug.provider_conflict and got[0].resolution.resolution_path[1] == "openmap-with-fallback_reverse_geocode" and got[3].resolution.confidence is None
    zones = g.resolve_with(g.RecordedZones(), points, "id")
    assert zones.count() == 5 and zones.first().resolution.confidence == "high"
    with pytest.raises(NotImplementedError):
        g.Provider().bundles(points, "id")
