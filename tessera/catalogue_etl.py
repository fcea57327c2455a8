"""More registered queries: responses, provinces, recorded geocoders, addresses, ETL, display and knowledge texts.

Inputs are derived from the tables' keys, so that both engines build the same names, payloads and pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.catalogue import COMMUNE_SQL, NAMES_SQL, ORACLE_SQL, PROVINCE_SQL, fold_sql, lit, names, norm_sql, points, points_sql, query, rows, values
from tessera.functions import geo, lookup, numeric, text
from tessera.operators import address, etl, geocode, knowledge, profile, provinces, resolve, union
from tessera.sources import files, seeds

NONE = "CAST(NULL AS VARCHAR)"


def key() -> Column:
    return F.col("c_custkey")


def nation() -> Column:
    return F.col("n_nationkey")


def pick(options: list, at: Column) -> Column:
    return F.get(F.array(*[F.lit(x).cast("string") for x in options]), (at % len(options)).cast("int"))


def pick_sql(options: list, at: str) -> str:
    return f"list_extract({lit(options)},CAST({at}%{len(options)} AS INT)+1)"


def customers(spark, sf_dir, *columns) -> DataFrame:
    return rows(spark, sf_dir, "customer").select("c_custkey", *columns)


# ---- the full response ----

_WITH, _ = ORACLE_SQL["resolve_confidence"].rsplit("\nSELECT", 1)
_STEP = "CASE WHEN d.tier IN ('exact','alias','fuzzy') AND d.matched IS NULL THEN d.tier||'_many' ELSE d.tier END"
_CASE = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + " END"
_FULL = f"""{_WITH},
p AS (SELECT code,name FROM province), c AS (SELECT code,name,type FROM commune),
s AS (SELECT h.*,pc.poly,d.tier,d.matched,d.alternatives,lx.crosswalk,{_STEP} AS step,
 matched IS NULL AND cc IS NULL AND poly IS NOT NULL AS by_poly FROM h JOIN pc USING (c_custkey) JOIN ladder d USING (c_custkey) JOIN lx USING (c_custkey)),
r AS (SELECT *,matched IS NULL AND NOT by_poly AND crosswalk IS NOT NULL AS by_cross,coalesce(pp<>np,FALSE) AS conflict,coalesce(matched,CASE WHEN by_poly THEN poly END,crosswalk) AS code FROM s),
f AS (SELECT r.*,p.name AS pname,pn.name AS nname,pq.name AS qname,c.name AS cname,c.type AS ctype FROM r LEFT JOIN p ON p.code=r.province LEFT JOIN p pn ON pn.code=r.np LEFT JOIN p pq ON pq.code=r.pp LEFT JOIN c ON c.code=r.code)
SELECT c_custkey,CASE WHEN NOT valid THEN {lit(resolve.LAT_RANGE)} END AS error,
 CASE WHEN valid AND cc IS NOT NULL THEN {norm_sql('cc')} END AS norm_commune,CASE WHEN valid AND cp IS NOT NULL THEN {norm_sql('cp')} END AS norm_province,
 CASE WHEN valid AND lc IS NOT NULL THEN {norm_sql('lc')} END AS norm_legacy_commune,CASE WHEN valid AND lp IS NOT NULL THEN {norm_sql('lp')} END AS norm_legacy_province,
 CASE WHEN valid THEN lc END AS legacy_commune,CASE WHEN valid THEN ld END AS legacy_district,CASE WHEN valid THEN lp END AS legacy_province,
 CASE WHEN valid THEN province END AS province_code,CASE WHEN valid THEN pname END AS province_name,CASE WHEN valid THEN code END AS commune_code,
 CASE WHEN valid THEN coalesce(cname,cc) END AS commune_name,
 CASE WHEN valid THEN coalesce(ctype,CASE WHEN lower(cc) LIKE 'phường%' OR lower(cc) LIKE 'thị trấn%' THEN 'phuong' WHEN lower(cc) LIKE 'đặc khu%' THEN 'dac_khu' WHEN cc IS NOT NULL THEN 'xa' END) END AS commune_type,
 CASE WHEN valid THEN CASE WHEN alternatives='' THEN '' ELSE array_to_string([x||':'||{_CASE(lookup.REASON, 'step')} FOR x IN string_split(alternatives,',')],'|') END END AS alternatives,
 CASE WHEN valid THEN CASE WHEN province IS NULL THEN 'low' WHEN matched IS NOT NULL THEN 'high' WHEN by_poly OR cc IS NOT NULL THEN 'medium' ELSE 'low' END END AS confidence,
 CASE WHEN valid THEN 'province_polygon>mock_reverse_geocode>normalize_names>current_ward_lookup_within_resolved_province'||CASE WHEN by_cross THEN '>legacy_commune_crosswalk' ELSE '' END END AS path,
 CASE WHEN valid THEN array_to_string([x FOR x IN [CASE WHEN pp IS NULL THEN {lit(resolve.NO_POLYGON)} END,CASE WHEN conflict THEN {lit(resolve.CONFLICT[0])}||nname||{lit(resolve.CONFLICT[1])}||qname||{lit(resolve.CONFLICT[2])} END,
  CASE WHEN by_poly THEN {lit(resolve.BY_POLYGON)} END,{_CASE(lookup.EXPLANATION, 'step')},CASE WHEN by_cross THEN {lit(resolve.BY_CROSSWALK)} END,CASE WHEN province IS NULL THEN {lit(resolve.NO_PROVINCE)} END] IF x IS NOT NULL],'|') END AS notes,
 CASE WHEN valid THEN pp IS NOT NULL END AS province_polygon_match,CASE WHEN valid THEN matched IS NOT NULL END AS unique_commune_match FROM f"""


@query(_FULL)
def resolve_response(spark, sf_dir):
    r, m = F.col("resolution"), F.col("resolution.current_match")
    n, old, debug = r["normalized"], r["legacy_match"], r["debug"]
    return resolve.resolve(points(spark, sf_dir, True)).select(
        "c_custkey", r["error"].alias("error"),
        n["current_commune_or_ward"].alias("norm_commune"), n["current_province"].alias("norm_province"), n["legacy_commune_or_ward"].alias("norm_legacy_commune"), n["legacy_province"].alias("norm_legacy_province"),
        old["legacy_commune_or_ward"].alias("legacy_commune"), old["legacy_district"].alias("legacy_district"), old["legacy_province"].alias("legacy_province"),
        m["province_code"].alias("province_code"), m["province_name"].alias("province_name"), m["commune_code"].alias("commune_code"), m["commune_name"].alias("commune_name"), m["commune_type"].alias("commune_type"),
        F.array_join(F.transform(r["alternatives"], lambda a: F.concat(a["commune_code"], F.lit(":"), a["reason"])), "|").alias("alternatives"),
        r["confidence"].alias("confidence"), F.array_join(r["resolution_path"], ">").alias("path"), F.array_join(debug["notes"], "|").alias("notes"),
        debug["province_polygon_match"].alias("province_polygon_match"), debug["unique_commune_match"].alias("unique_commune_match"),
    )


# ---- provinces ----

_SUMMARY_SQL = values("summary", "ord,province_id,province_code,province_name,province_kind,description", [(i, f"p-{i:03d}", p[0], p[1], p[2], d) for i, (p, d) in enumerate(zip(seeds.PROVINCES, seeds.DESCRIPTIONS, strict=True), 1)])
_KEYS_SQL = f"""pk AS (SELECT ord,code,unnest(list_concat([name,code,replace(code,'-',' '),replace(regexp_replace(code,'-city$',''),'-',' ')],aliases)) AS raw,generate_subscripts(list_concat([name,code,'',''],aliases),1) AS i FROM province),
pn AS (SELECT ord,code,i,{norm_sql('raw')} AS k FROM pk), pd AS (SELECT ord,code,k,min(i) AS i FROM pn WHERE k<>'' GROUP BY ord,code,k)"""


@query(f"WITH {_SUMMARY_SQL},{PROVINCE_SQL} SELECT s.*,array_to_string(p.aliases,'|') AS aliases FROM summary s JOIN province p ON p.code=s.province_code")
def province_summary(spark, sf_dir):
    return provinces.summaries(spark).withColumn("aliases", F.array_join("aliases", "|"))


@query(f"WITH {PROVINCE_SQL},{_KEYS_SQL} SELECT code AS province_code,string_agg(k,'|' ORDER BY i) AS keys FROM pd GROUP BY code")
def province_lookup_keys(spark, sf_dir):
    return seeds.provinces(spark).select("province_code", F.array_join(provinces.lookup_keys(F.col("province_name"), F.col("province_code"), F.col("aliases")), "|").alias("keys"))


#: Documents and snapshots by keys that some provinces have, some of them twice.
_FILES = ["HaNoi", "Hue", "HoChiMinh", "DakLak", "YenBai", "BinhDuong", "SocTrang", "Atlantis"]
_SNAPSHOTS = [("Hà Nội", "Thủ đô Hà Nội", "ha-noi"), ("TP. Hồ Chí Minh", "Thành phố Hồ Chí Minh", "ho-chi-minh"), ("Huế", "Thành phố Huế", "hue"), ("Hà Nội", "Thành phố Hà Nội", "ha-noi-2"), ("Xứ khác", "Một xứ khác", "soc-trang")]


def _documents(spark) -> DataFrame:
    own = spark.createDataFrame([(i, f) for i, f in enumerate(_FILES)], "ord int, file string")
    return own.select(text.normalize_admin_name(text.camel_split(F.col("file"))).alias("key"), F.col("file").alias("value"))


def _snapshots(spark) -> DataFrame:
    own = spark.createDataFrame([(i, *s) for i, s in enumerate(_SNAPSHOTS)], "ord int, name string, full string, slug string")
    keyed = own.withColumn("keys", provinces.snapshot_keys(F.col("name"), F.col("full"), F.col("slug")))
    return provinces.last_by_key(keyed, "keys", "ord", "full")


_DETAIL_SQL = f"""{PROVINCE_SQL},{COMMUNE_SQL},{_KEYS_SQL},{values('fl', 'file', [(f,) for f in _FILES])},{values('sn', 'ord,name,"full",slug', [(i, *s) for i, s in enumerate(_SNAPSHOTS)])},
dk AS (SELECT {norm_sql("regexp_replace(file,'([a-z])([A-Z])','\\1 \\2','g')")} AS k,file FROM fl),
sk AS (SELECT k,arg_max("full",ord) AS "full" FROM (SELECT ord,"full",{norm_sql('raw')} AS k FROM (SELECT ord,"full",unnest([name,"full",replace(slug,'-',' ')]) AS raw FROM sn)) WHERE k<>'' GROUP BY k),
pi AS (SELECT code,arg_min(file,i) AS file FROM pd JOIN dk USING (k) GROUP BY code), ps AS (SELECT code,arg_min("full",i) AS snap FROM pd JOIN sk USING (k) GROUP BY code),
detail AS (SELECT p.code,p.name,(SELECT count(*) FROM commune c WHERE c.province=p.code) AS n,pi.file,ps.snap FROM province p LEFT JOIN pi USING (code) LEFT JOIN ps USING (code))"""
_CODES = [*[p[0] for p in seeds.PROVINCES], "nowhere", ""]


@query(f"WITH {_DETAIL_SQL} SELECT c_custkey,CASE WHEN d.code IS NULL THEN 404 ELSE 200 END AS status,CASE WHEN d.code IS NULL THEN {lit(provinces.NOT_FOUND)} END AS message,d.name AS province_name,CAST(d.n AS INT) AS commune_count,d.file,d.snap FROM (SELECT c_custkey,{pick_sql(_CODES, 'c_custkey')} AS code FROM customer) q LEFT JOIN detail d USING (code)")
def province_detail(spark, sf_dir):
    asked = customers(spark, sf_dir, pick(_CODES, key()).alias("code"))
    found = provinces.details(asked, "code", _documents(spark), _snapshots(spark))
    d = F.col("detail")
    return found.select("c_custkey", "status", "message", d["province_name"].alias("province_name"), d["commune_count"].alias("commune_count"), d["province_info"].alias("file"), d["reference_snapshot"].alias("snap"))


@query("WITH o AS (SELECT o_custkey,o_orderkey,unnest(['s'||o_orderstatus,'p'||left(o_orderpriority,1),'c'||o_custkey%7]) AS key FROM orders) SELECT key,arg_max(o_orderkey,o_orderkey) AS value FROM o GROUP BY key")
def last_write_wins(spark, sf_dir):
    o = rows(spark, sf_dir, "orders").withColumn("keys", F.array(F.concat(F.lit("s"), "o_orderstatus"), F.concat(F.lit("p"), F.left("o_orderpriority", F.lit(1))), F.concat(F.lit("c"), (F.col("o_custkey") % 7).cast("string"))))
    return provinces.last_by_key(o, "keys", "o_orderkey", "o_orderkey")


@query("SELECT c_custkey,CAST(coalesce(CASE WHEN c_custkey%3=0 THEN c_custkey*1.5 END,CASE WHEN c_custkey%5<>0 THEN c_custkey*2.5 END) AS DOUBLE) AS area_km2,coalesce(CASE WHEN c_custkey%4=0 THEN 't'||c_custkey END,CASE WHEN c_custkey%2=0 THEN 'a'||c_custkey END,'code') AS admin_code,CASE WHEN c_custkey%3=0 THEN '' ELSE 'n'||c_custkey||',m' END||CASE WHEN c_custkey%7=0 THEN CASE WHEN c_custkey%3=0 THEN 'Lào' ELSE ',Lào' END ELSE '' END AS neighbours FROM customer")
def profile_display(spark, sf_dir):
    none = F.array().cast("array<string>")
    double = lambda x: x.cast("double")
    snap = F.struct(F.when(key() % 4 == 0, F.concat(F.lit("t"), key())).alias("province_code_text"), F.when(key() % 3 == 0, double(key() * 1.5)).alias("area_km2"), double(F.lit(None)).alias("population"), double(F.lit(None)).alias("total_unit"), F.when(key() % 3 == 0, none).alias("border_with_provinces"))
    prof = F.struct(F.when(key() % 2 == 0, F.concat(F.lit("a"), key())).alias("administrative_code"), F.when(key() % 5 != 0, double(key() * 2.5)).alias("area_km2"), double(F.lit(None)).alias("population"), double(F.lit(None)).alias("density"), double(F.lit(None)).alias("total_units"), F.array(F.concat(F.lit("n"), key()), F.lit("m")).alias("neighbours"), F.when(key() % 7 == 0, F.array(F.lit("Lào"))).alias("countries"))
    own = customers(spark, sf_dir, provinces.display(snap, prof, F.lit("code")).alias("x"))
    return own.select("c_custkey", "x.area_km2", "x.admin_code", F.array_join("x.neighbours", ",").alias("neighbours"))


@query("SELECT c_custkey,'Kinh|Hoa|Khmer ('||replace(CAST(c_custkey%100+0.25 AS VARCHAR),'.',',')||'%)' AS groups FROM customer")
def ethnic_groups(spark, sf_dir):
    doc = F.concat(F.lit('["Kinh",{"name":"Hoa"},{"name":"Khmer","percentage":'), (key() % 100 + 0.25).cast("string"), F.lit("}]"))
    items = F.try_variant_get(F.try_parse_json(doc), "$", "array<variant>")
    return customers(spark, sf_dir, F.array_join(F.transform(items, provinces.ethnic_group), "|").alias("groups"))


@query(f"WITH {PROVINCE_SQL} SELECT code AS province_code,CASE WHEN code='hue' THEN '#e25f3f' ELSE '#86c8c3' END AS fill,'#86c8c3' AS plain,code='hanoi' AS picked,CASE kind WHEN 'city' THEN 'Thành phố trực thuộc Trung ương' ELSE 'Tỉnh' END AS kind_label FROM province")
def province_fill(spark, sf_dir):
    code = F.col("province_code")
    rows_ = seeds.provinces(spark)
    one = provinces.feature_by_code(rows_, "hanoi").select(F.col("province_code").alias("one"))
    return rows_.join(F.broadcast(one), code == F.col("one"), "left").select("province_code", provinces.fill_colour(code, F.lit("hue")).alias("fill"), provinces.fill_colour(code, F.lit(None).cast("string")).alias("plain"), F.col("one").isNotNull().alias("picked"), text.province_kind_label(F.col("province_kind")).alias("kind_label"))


def _square(x: Column, y: Column, side: Column) -> Column:
    return geo.ring(x, y, x + side, y + side)


@query("SELECT c_custkey,CASE WHEN c_custkey%5>=c_custkey%3 THEN 1.0+(c_custkey%5+1)/2.0 ELSE 100.0+(c_custkey%3+1)/2.0 END AS lon,CASE WHEN c_custkey%5>=c_custkey%3 THEN 2.0+(c_custkey%5+1)/2.0 ELSE 200.0+(c_custkey%3+1)/2.0 END AS lat FROM customer")
def label_points(spark, sf_dir):
    d = lambda v: F.lit(float(v))
    side = lambda m: (key() % m + 1).cast("double")
    shape = F.array(F.array(_square(d(1), d(2), side(5))), F.array(_square(d(100), d(200), side(3)), _square(d(100), d(200), d(9))))
    return provinces.labels(customers(spark, sf_dir, shape.alias("geometry"))).select("c_custkey", "label.lon", "label.lat")


@query(f"WITH {points_sql()} SELECT c_custkey,(lon BETWEEN 103 AND 108 AND lat BETWEEN 10 AND 20 AND NOT (lon>104 AND lon<106 AND lat>12 AND lat<18)) OR (lon BETWEEN 108.5 AND 109 AND lat BETWEEN 9 AND 23) AS inside FROM point")
def polygon_with_hole(spark, sf_dir):
    box = lambda w, s, e, n: geo.ring(*[F.lit(float(v)) for v in (w, s, e, n)])
    shape = F.array(F.array(box(103, 10, 108, 20), box(104, 12, 106, 18)), F.array(box(108.5, 9, 109, 23)))
    return points(spark, sf_dir).select("c_custkey", geo.in_multipolygon(shape, F.col("lon"), F.col("lat")).alias("inside"))


@query(f"""WITH {PROVINCE_SQL},r AS (SELECT code,radians(w) AS x0,radians(e) AS x1,-ln(tan(pi()/4+radians(n)/2)) AS y0,-ln(tan(pi()/4+radians(s)/2)) AS y1 FROM province),
k AS (SELECT *,least(272/(x1-x0),272/(y1-y0)) AS k FROM r), t AS (SELECT *,24+(272-k*(x0+x1))/2 AS tx,24+(272-k*(y0+y1))/2 AS ty FROM k)
SELECT code AS province_code,'M'||printf('%.3f,%.3f',k*x0+tx,k*y1+ty)||'L'||printf('%.3f,%.3f',k*x1+tx,k*y1+ty)||'L'||printf('%.3f,%.3f',k*x1+tx,k*y0+ty)||'L'||printf('%.3f,%.3f',k*x0+tx,k*y0+ty)||'Z' AS path FROM t""")
def mercator_path(spark, sf_dir):
    return seeds.provinces(spark).select("province_code", geo.mercator_path(geo.ring(*[F.col(c) for c in ("west", "south", "east", "north")])).alias("path"))


@query(f"WITH {PROVINCE_SQL},n AS (SELECT *,trim(regexp_replace(lower({fold_sql('name')}),'[^a-z0-9]+',' ','g')) AS k FROM province) SELECT code AS province_code,row_number() OVER (ORDER BY k) AS by_key,row_number() OVER (ORDER BY code) AS by_code,row_number() OVER (ORDER BY code||'.json') AS by_file FROM n")
def province_orders(spark, sf_dir):
    at = lambda c: F.row_number().over(Window.orderBy(c)).cast("long")
    return seeds.provinces(spark).select("province_code", at(text.normalize_key(F.col("province_name"))).alias("by_key"), at("province_code").alias("by_code"), at(F.concat("province_code", F.lit(".json"))).alias("by_file"))


#: Names in Vietnamese alphabetical order.
_ORDERED = ["phường An", "phường Ăn", "phường Ân", "phường Ba", "phường Cam", "phường Dung", "phường Đa", "phường Ê", "phường Ông", "phường Ơn", "xã Ưng", "xã Vang"]


@query(f"WITH {values('o', 'place,name', [(i, n) for i, n in enumerate(_ORDERED, 1)])} SELECT name,place FROM o")
def vietnamese_order(spark, sf_dir):
    own = spark.createDataFrame([(n,) for n in sorted(_ORDERED, key=len)], "name string")
    return provinces.place_in_order(own, "name")


# ---- recorded geocoders ----


def _json(**fields) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _address_payload() -> Column:
    own = F.struct(F.when(key() % 2 == 0, F.concat(F.lit("q"), key())).alias("quarter"), F.when(key() % 3 == 0, F.concat(F.lit("s"), key())).alias("suburb"), F.when(key() % 5 != 0, F.concat(F.lit("h"), key())).alias("hamlet"), F.when(key() % 4 == 0, F.concat(F.lit("d"), key())).alias("district"), F.concat(F.lit("c"), key()).alias("county"), F.when(key() % 6 == 0, F.lit("")).alias("city"), F.when(key() % 7 != 0, F.lit("Tỉnh Bắc Kạn")).alias("town"), F.lit("Huế").alias("state"))
    return F.when(key() % 13 == 0, F.lit("{bad")).otherwise(_json(display_name=F.when(key() % 9 != 0, F.concat(F.lit("at "), key())), address=own))


_ADDRESS_SQL = "CASE WHEN c_custkey%13<>0 THEN coalesce(CASE WHEN c_custkey%2=0 THEN 'q'||c_custkey END,CASE WHEN c_custkey%3=0 THEN 's'||c_custkey END,CASE WHEN c_custkey%5<>0 THEN 'h'||c_custkey END) END AS commune,CASE WHEN c_custkey%13<>0 THEN CASE WHEN c_custkey%4=0 THEN 'd' ELSE 'c' END||c_custkey END AS district,CASE WHEN c_custkey%13<>0 THEN CASE WHEN c_custkey%6=0 THEN '' WHEN c_custkey%7<>0 THEN 'Tỉnh Bắc Kạn' ELSE 'Huế' END END AS province,CASE WHEN c_custkey%13=0 OR c_custkey%9=0 THEN '' ELSE 'at '||c_custkey END AS formatted"


@query(f"SELECT c_custkey,{_ADDRESS_SQL} FROM customer")
def geocode_address(spark, sf_dir):
    found = customers(spark, sf_dir, geocode.address_bundle(_address_payload())["current"].alias("x"))
    return found.select("c_custkey", "x.commune", "x.district", "x.province", F.col("x.formatted_address").alias("formatted"))


def _component(kinds: list[str], name: Column) -> Column:
    return F.struct(name.alias("long_name"), F.array(*[F.lit(k) for k in kinds]).alias("types"))


def _component_payload() -> Column:
    parts = F.array(_component(["political"], F.lit(" ")), _component(["political", "sublocality"], F.when(key() % 2 == 0, F.concat(F.lit("phường S"), key()))), _component(["administrative_area_level_2"], F.when(key() % 4 == 0, F.concat(F.lit("quận Q"), key() % 5))), _component(["locality"], F.concat(F.lit("L"), key())), _component(["sublocality_level_1"], F.when(key() % 3 == 0, F.concat(F.lit("phường V"), key()))), _component(["administrative_area_level_1"], F.when(key() % 5 != 0, F.concat(F.lit("tỉnh A"), key() % 3))))
    return _json(results=F.array(F.struct(F.when(key() % 7 != 0, F.concat(F.lit("old "), key())).alias("formatted_address"), parts.alias("address_components"))))


def _prediction_payload() -> Column:
    terms = F.array(*[F.struct(v.alias("value")) for v in (F.concat(F.lit("x"), key()), F.concat(F.lit("phường P"), key()), F.when(key() % 2 == 0, F.lit("tỉnh T")).otherwise("T"))])
    return F.when(key() % 3 != 1, _json(predictions=F.array(F.struct(F.concat(F.lit("new "), key()).alias("description"), terms.alias("terms"))))).otherwise(F.lit('{"predictions":[]}'))


_COMPONENT_SQL = "o AS (SELECT c_custkey AS k,coalesce(CASE WHEN c_custkey%3=0 THEN 'phường V'||c_custkey END,CASE WHEN c_custkey%2=0 THEN 'phường S'||c_custkey END) AS gc,coalesce(CASE WHEN c_custkey%5<>0 THEN 'tỉnh A'||c_custkey%3 END,'L'||c_custkey) AS gp,CASE WHEN c_custkey%4=0 THEN 'quận Q'||c_custkey%5 END AS gd,c_custkey%7<>0 AS full_,c_custkey%7<>0 AND c_custkey%3<>1 AS pred FROM customer)"


@query(f"WITH {_COMPONENT_SQL} SELECT k AS c_custkey,CASE WHEN pred THEN 'phường P'||k ELSE gc END AS commune,CASE WHEN pred AND k%2=0 THEN 'tỉnh T' ELSE gp END AS province,CASE WHEN pred THEN 'new '||k ELSE concat_ws(', ',gc,gp) END AS formatted,CASE WHEN pred THEN 'openmap-admin-v2' ELSE 'openmap' END AS provider,CASE WHEN full_ THEN 'old '||k END AS old_formatted,CASE WHEN full_ THEN gc END AS old_commune,CASE WHEN full_ THEN gd END AS old_district,CASE WHEN full_ THEN gp END AS old_province FROM o")
def geocode_components(spark, sf_dir):
    found = customers(spark, sf_dir, geocode.component_bundle(_component_payload(), geocode.first_prediction(_prediction_payload())).alias("x"))
    new, old = F.col("x.current"), F.col("x.legacy")
    return found.select("c_custkey", new["commune"].alias("commune"), new["province"].alias("province"), new["formatted_address"].alias("formatted"), new["provider_name"].alias("provider"), old["formatted_address"].alias("old_formatted"), old["commune"].alias("old_commune"), old["district"].alias("old_district"), old["province"].alias("old_province"))


#: Recorded answers to searches: level, query, place, code, name, code of the division above.
_DIVISIONS = [("p", "tỉnh A0", 0, 1, "Tỉnh Khác", None), ("p", "tỉnh A0", 1, 2, "Tỉnh A0", None), ("p", "tỉnh A1", 0, 3, "Xứ B", None), ("d", "quận Q0", 0, 10, "Quận Q0", 9), ("d", "quận Q0", 1, 11, "Huyện Q0", 2), ("d", "quận Q1", 0, 12, "Huyện Lạ", 3), ("d", "quận Q1", 1, 13, "Thị xã Q1", 8), ("w", "phường W0", 0, 20, "Xã W0", 11), ("w", "phường W0", 1, 21, "Phường W0", 12), ("w", "phường W1", 0, 22, "Xã Lạ", 7)]
_DIVISION_SCHEMA = "level string, query string, ord int, code int, name string, parent_code int"
_STRIP = lambda x: f"lower(trim(regexp_replace({x},'^(tỉnh|thành phố|thị xã|quận|huyện|thị trấn|phường|xã)\\s+','','i')))"


def _level_sql(level: str, asked: str, parent: str | None) -> str:
    a, b = _STRIP("v.name"), _STRIP(asked)
    under = f"CASE WHEN {parent} IS NULL THEN 0 WHEN v.parent_code={parent} THEN 0 ELSE 1 END," if parent else ""
    return f"(SELECT struct_pack(code:=v.code,name:=v.name) FROM dv v WHERE v.level='{level}' AND v.query={asked} ORDER BY {under}CASE WHEN contains({a},{b}) OR contains({b},{a}) THEN 0 ELSE 1 END,v.ord LIMIT 1)"


@query(f"WITH {values('dv', 'level,query,ord,code,name,parent_code', _DIVISIONS)},a AS (SELECT c_custkey,'tỉnh A'||c_custkey%3 AS p,'quận Q'||c_custkey%4 AS d,CASE WHEN c_custkey%5=0 THEN '' ELSE 'phường W'||c_custkey%2 END AS w FROM customer),x AS (SELECT *,{_level_sql('p', 'a.p', None)} AS pv FROM a),y AS (SELECT *,{_level_sql('d', 'x.d', 'x.pv.code')} AS dvn FROM x),z AS (SELECT *,{_level_sql('w', 'y.w', 'y.dvn.code')} AS wv FROM y) SELECT c_custkey,pv.name AS province,pv.code AS province_code,dvn.name AS district,dvn.code AS district_code,wv.name AS ward,wv.code AS ward_code FROM z")
def division_chain(spark, sf_dir):
    asked = customers(spark, sf_dir, F.concat(F.lit("tỉnh A"), key() % 3).alias("province"), F.concat(F.lit("quận Q"), key() % 4).alias("district"), F.when(key() % 5 == 0, "").otherwise(F.concat(F.lit("phường W"), key() % 2)).alias("ward"))
    found = geocode.division_chain(asked, spark.createDataFrame(_DIVISIONS, _DIVISION_SCHEMA))
    d = F.col("division")
    return found.select("c_custkey", *[d[level][f].alias(level if f == "name" else f"{level}_code") for level in ("province", "district", "ward") for f in ("name", "code")])


@query(f"WITH {_COMPONENT_SQL} SELECT k AS c_custkey,CASE WHEN full_ OR gd IS NOT NULL THEN CASE WHEN gd IS NOT NULL THEN concat_ws(', ',gc,gd||'!',gp) ELSE 'old '||k END END AS old_formatted,CASE WHEN gd IS NOT NULL THEN gd||'!' END AS old_district FROM o")
def geocode_enriched(spark, sf_dir):
    name = F.when(key() % 4 == 0, F.concat(F.lit("quận Q"), key() % 5, F.lit("!")))
    none = F.lit(None).cast("string")
    found = customers(spark, sf_dir, geocode.component_bundle(_component_payload(), geocode.first_prediction(_prediction_payload()), F.struct(none.alias("province"), name.alias("district"), none.alias("ward")))["legacy"].alias("x"))
    return found.select("c_custkey", F.col("x.formatted_address").alias("old_formatted"), F.col("x.district").alias("old_district"))


@query(f"SELECT c_custkey,CASE WHEN c_custkey%3=0 THEN 'second' ELSE 'first' END AS provider,CASE WHEN c_custkey%6=0 THEN {lit(geocode.UNKNOWN_REASON)} WHEN c_custkey%3=0 THEN 'HTTP '||c_custkey WHEN FALSE THEN '' END AS fallback_reason FROM customer")
def geocode_fallback(spark, sf_dir):
    none = F.lit(None).cast("string")
    one = lambda p: geocode.bundle(geocode.candidate(F.lit(""), none, none, none, F.lit(p), none))
    answers = customers(spark, sf_dir, F.lit("{}").alias("payload"), F.when(key() % 6 == 0, "").when(key() % 3 == 0, F.concat(F.lit("HTTP "), key())).alias("error"))
    asked = geocode.recorded(customers(spark, sf_dir), answers, "c_custkey", "answer")
    found = asked.select("c_custkey", geocode.with_fallback(one("first"), F.col("answer.error"), one("second")).alias("x"))
    return found.select("c_custkey", F.col("x.bundle.current.provider_name").alias("provider"), "x.fallback_reason")


_REQUEST = "CASE c_custkey%4 WHEN 0 THEN ' ngõ '||c_custkey||' ' WHEN 1 THEN '  ' END"


@query(f"""WITH r AS (SELECT c_custkey AS k,trim({_REQUEST}) AS t,CASE WHEN c_custkey%5<>0 THEN 'xã C' END AS c,CASE WHEN c_custkey%7=0 THEN '' ELSE 'huyện D' END AS d,CASE WHEN c_custkey%3=0 THEN '' ELSE 'tỉnh P' END AS p FROM customer),
m AS (SELECT *,CASE WHEN k%11=0 THEN NULL WHEN t<>'' THEN 'text' WHEN p<>'' THEN 'fields' END AS mode,k%8<>0 AS has_old,k%6<>0 AS has_new FROM r),
q AS (SELECT *,CASE mode WHEN 'text' THEN t WHEN 'fields' THEN concat_ws(' ',nullif(c,''),nullif(d,''),p) END AS query,CASE WHEN k%11=0 THEN 503 WHEN mode IS NULL THEN 400 WHEN NOT has_old AND NOT has_new THEN 404 ELSE 200 END AS status FROM m)
SELECT k AS c_custkey,mode,query,status,CASE status WHEN 503 THEN {lit(address.NO_KEY)} WHEN 400 THEN {lit(address.NO_INPUT)} WHEN 404 THEN {lit(address.NOT_FOUND)} END AS message,
CASE WHEN status=200 THEN CASE WHEN has_old THEN 'phường O' WHEN mode='fields' THEN c END END AS old_commune,CASE WHEN status=200 THEN CASE WHEN has_old THEN 'old '||k ELSE query END END AS old_formatted,
CASE WHEN status=200 AND has_new AND k%2=0 THEN 'thành phố N' END AS new_province,CASE WHEN status=200 THEN has_new AND k%2=0 END AS found FROM q""")
def address_requests(spark, sf_dir):
    asked = address.request(F.when(key() % 4 == 0, F.concat(F.lit(" ngõ "), key(), F.lit(" "))).when(key() % 4 == 1, "  "), F.when(key() % 5 != 0, "xã C"), F.when(key() % 7 == 0, "").otherwise("huyện D"), F.when(key() % 3 == 0, "").otherwise("tỉnh P"), key() % 11 != 0)
    prediction = lambda description, *terms: F.concat(F.lit('{"predictions":[{"description":"'), description, F.lit('","terms":[' + ",".join(f'{{"value":"{t}"}}' for t in terms) + "]}]}"))
    old = F.when(key() % 8 != 0, prediction(F.concat(F.lit("old "), key()), "nhà", "phường O", "quận O"))
    new = F.when(key() % 6 == 0, F.lit('{"predictions":[]}')).when(key() % 2 == 0, prediction(F.lit("new"), "phường N", "thành phố N")).otherwise(prediction(F.lit("new"), "phường N"))
    found = customers(spark, sf_dir, asked.alias("asked")).withColumn("x", address.answer(F.col("asked"), geocode.first_prediction(old), geocode.first_prediction(new)))
    x = F.col("x")
    return found.select("c_custkey", "asked.mode", "asked.query", x["status"].alias("status"), x["message"].alias("message"), x["old_address"]["commune"].alias("old_commune"), x["old_address"]["formatted"].alias("old_formatted"), x["new_address"]["province"].alias("new_province"), x["found"].alias("found"))


@query("SELECT c_custkey,CASE WHEN c_custkey%4=0 THEN 'HTTP '||c_custkey%3 WHEN c_custkey%5=0 THEN 'Không rõ nguyên nhân' WHEN c_custkey%7=0 THEN 'Dịch vụ bản đồ trả về lỗi: Unable' END AS error FROM customer")
def geocode_errors(spark, sf_dir):
    payload = F.when(key() % 5 == 0, "{bad").when(key() % 7 == 0, '{"error":"Unable"}').otherwise('{"error":""}')
    error = F.when(key() % 4 == 0, F.concat(F.lit("HTTP "), key() % 3))
    return customers(spark, sf_dir, geocode.json_error(F.try_parse_json(payload), payload, error).alias("error"))


# ---- ETL ----

_ELEMENT_SQL = f"""{NAMES_SQL},{points_sql()},e AS (SELECT c_custkey,CASE WHEN c_custkey%7=0 THEN NULL ELSE raw END AS name,CASE WHEN c_custkey%5<>0 THEN lat END AS lat,lon FROM name JOIN point USING (c_custkey)),
l AS (SELECT e.*,(SELECT arg_min(v.code,v.ord) FROM province v WHERE e.lon BETWEEN v.w AND v.e AND e.lat BETWEEN v.s AND v.n) AS p FROM e),
rec AS (SELECT *,CASE WHEN name IS NULL THEN 'no_name' WHEN lat IS NULL THEN 'no_centre' WHEN p IS NULL THEN 'no_province' END AS skipped FROM l)"""
_SLUG = f"regexp_replace(regexp_replace(lower({fold_sql('name')}),'[^a-z0-9]+','-','g'),'^-|-$','','g')"


def _elements(spark, sf_dir) -> DataFrame:
    own = names(spark, sf_dir).select("c_custkey", F.when(key() % 7 != 0, F.col("raw")).alias("raw")).join(points(spark, sf_dir), "c_custkey")
    return own.select("c_custkey", F.when(key() % 2 == 0, F.col("raw")).alias("name_vi"), F.when(key() % 2 == 1, F.col("raw")).alias("name"), F.when(key() % 5 != 0, F.col("lat")).alias("lat"), "lon")


@query(f"WITH {PROVINCE_SQL},{_ELEMENT_SQL} SELECT c_custkey,skipped,CASE WHEN skipped IS NULL THEN p END AS province_code,CASE WHEN skipped IS NULL THEN p||'-'||{_SLUG} END AS commune_code,CASE WHEN skipped IS NULL THEN CASE WHEN regexp_matches(lower(name),'^(phường|phuong|thị trấn|thi tran)([^a-z0-9_]|$)') THEN 'phuong' WHEN regexp_matches(lower(name),'^(đặc khu|dac khu)([^a-z0-9_]|$)') THEN 'dac_khu' ELSE 'xa' END END AS commune_type FROM rec")
def commune_elements(spark, sf_dir):
    found = etl.element_records(_elements(spark, sf_dir))
    return found.select("c_custkey", "record.skipped", "record.province_code", "record.commune_code", "record.commune_type")


@query(f"WITH {PROVINCE_SQL},{_ELEMENT_SQL} SELECT count(*) FILTER (WHERE skipped IS NULL) AS total_communes,count(DISTINCT p) FILTER (WHERE skipped IS NULL) AS total_provinces,count(*) FILTER (WHERE skipped IS NOT NULL) AS skipped FROM rec")
def element_totals(spark, sf_dir):
    return etl.element_totals(etl.element_records(_elements(spark, sf_dir)))


@query(f"WITH {PROVINCE_SQL},{_ELEMENT_SQL} SELECT p AS province_code,count(*) AS n,count(DISTINCT name) AS names FROM rec WHERE skipped IS NULL GROUP BY p")
def communes_by_province(spark, sf_dir):
    found = etl.communes_by_province(etl.element_records(_elements(spark, sf_dir)))
    return found.select("province_code", "n", F.size(F.array_distinct(F.transform("communes", lambda c: c["commune_name"]))).cast("long").alias("names"))


_FORMER = [(i, n) for i, (n, _) in enumerate(reversed(seeds.FORMER_NAMES))] + [(99, "Atlantis")]


def _former(spark) -> DataFrame:
    x = F.col("ord").cast("double")
    return spark.createDataFrame(_FORMER, "ord int, name string").withColumn("geometry", F.array(F.array(_square(x, x, F.lit(1.0)))))


@query(f"WITH {values('former', 'ord,name', _FORMER)},{values('code', 'name,code', seeds.FORMER_NAMES)},{PROVINCE_SQL},g AS (SELECT c.code,min(f.ord) AS o,count(*) AS parts,string_agg(CAST(f.ord AS VARCHAR),',' ORDER BY f.ord) AS wests FROM former f JOIN code c USING (name) GROUP BY c.code) SELECT printf('p-%03d',row_number() OVER (ORDER BY o)) AS province_id,p.code AS province_code,p.name AS province_name,p.kind AS province_kind,parts,wests FROM g JOIN province p USING (code)")
def merged_features(spark, sf_dir):
    merged = etl.merged_features(_former(spark), seeds.former_names(spark), seeds.provinces(spark))
    wests = F.transform("geometry", lambda p: p[0][0]["lon"].cast("int").cast("string"))
    return merged.select("province_id", "province_code", "province_name", "province_kind", "parts", F.array_join(wests, ",").alias("wests"))


@query("WITH c AS (SELECT DISTINCT p_brand,p_size%7 AS x,p_size//7 AS y FROM part),s AS (SELECT a.p_brand,count(*) AS shared FROM c a JOIN c b ON a.p_brand=b.p_brand AND abs(a.x-b.x)+abs(a.y-b.y)=1 GROUP BY a.p_brand) SELECT p_brand,count(*) AS area,4*count(*)-coalesce(min(shared),0) AS boundary FROM c LEFT JOIN s USING (p_brand) GROUP BY p_brand")
def united_features(spark, sf_dir):
    """Cells of a grid, a unit a brand: area and length of the boundary of their union."""
    at = lambda c: F.expr(c).cast("double")
    cells = rows(spark, sf_dir, "part").select("p_brand", F.array(_square(at("p_size % 7"), at("p_size div 7"), F.lit(1.0))).alias("cell")).distinct()
    merged = union.united(cells.groupBy("p_brand").agg(F.array_sort(F.collect_list("cell")).alias("geometry")))
    over = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
    steps = lambda r: F.arrays_zip(F.slice(r, 1, F.size(r) - 1).alias("a"), F.slice(r, 2, F.size(r) - 1).alias("b"))
    length = lambda e: F.abs(e["a"]["lon"] - e["b"]["lon"]) + F.abs(e["a"]["lat"] - e["b"]["lat"])
    area = over(F.col("geometry"), lambda p: 2 * geo.ring_area(p[0]) - over(p, geo.ring_area))
    return merged.select("p_brand", area.cast("long").alias("area"), over(F.flatten("geometry"), lambda r: over(steps(r), length)).cast("long").alias("boundary"))


@query("SELECT 99 AS ord,'Atlantis' AS name")
def unmatched_features(spark, sf_dir):
    return etl.unmatched(_former(spark), seeds.former_names(spark)).select("ord", "name")


_UNIT = '{{"id":{id},"created_at":"x","ward_order":{o},"ward_name":"{n}","ward_code":"{c}","ward_type":"{t}","admin_center":"","merger_from":"{m}","province_id_ref":1,"province_code":2,"province_name":"P","population":"{p}","area":{a},"longitude":1,"latitude":2,"ward_ref_code":3,"tree_code":4,"district":"","search_normalized":"s","ward_slug":"s-{c}","province_slug":"p","updated_at":"u","old_province_name":null,"old_province_slug":"x","old_district":"{d}"}}'
_PART = {"id": "p_partkey", "o": "p_size", "n": "p_name", "c": "p_partkey%50", "t": "p_type", "m": "CASE WHEN p_partkey%3=0 THEN '' ELSE p_brand END", "p": "p_partkey*1000", "a": "p_retailprice", "d": "CASE WHEN p_partkey%2=0 THEN '' ELSE 'D' END"}


def _pages_of_units(spark, sf_dir) -> DataFrame:
    """A page a brand: its parts as escaped unit records among other text. Parts are gathered as their fields, and written
    out in the page's row."""
    escaped = lambda c: F.replace(c, F.lit('"'), F.lit('\\"'))

    def record(x: Column) -> Column:
        pieces = []
        for i, piece in enumerate(_UNIT.replace("{{", "{").replace("}}", "}").replace("{", "\0").split("\0")):
            key, mark, rest = piece.partition("}")
            if i > 1 and mark and key in _PART:
                pieces += [x[key], escaped(F.lit(rest))]
            else:
                pieces.append(escaped(F.lit(("{" if i else "") + piece)))
        return F.concat(*pieces)

    fields = F.struct("p_partkey", *[escaped(F.expr(v).cast("string")).alias(k) for k, v in _PART.items()])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(fields)), record), "<p>,</p>")
    return rows(spark, sf_dir, "part").groupBy("p_brand").agg(F.concat(F.lit("<html>["), joined, F.lit('{"id":1}]')).alias("html"))


@query("WITH u AS (SELECT p_brand,p_size AS ward_order,p_name AS ward_name,CAST(p_partkey%50 AS VARCHAR) AS ward_code,p_type AS ward_type,CASE WHEN p_partkey%3<>0 THEN p_brand END AS merger_from,CAST(p_partkey*1000 AS DOUBLE) AS population,p_retailprice AS area_km2,CASE WHEN p_partkey%2<>0 THEN 'D' END AS old_district,row_number() OVER (PARTITION BY p_brand,p_partkey%50 ORDER BY p_partkey) AS rn,p_partkey FROM part) SELECT p_brand,row_number() OVER (PARTITION BY p_brand ORDER BY ward_order,p_partkey) AS place,ward_order,ward_name,ward_code,ward_type,merger_from,population,area_km2,round(population/area_km2,2) AS density_per_km2,old_district FROM u WHERE rn=1")
def unit_records(spark, sf_dir):
    units = _pages_of_units(spark, sf_dir).select("p_brand", F.posexplode(etl.units_of(text.unescape_quotes(F.col("html")))).alias("at", "u"))
    return units.select("p_brand", (F.col("at") + 1).cast("long").alias("place"), *[F.col(f"u.{c}") for c in ("ward_order", "ward_name", "ward_code", "ward_type", "merger_from", "population", "area_km2", "density_per_km2", "old_district")])


@query("SELECT p_brand,string_agg(p_type,'|' ORDER BY f) AS types FROM (SELECT p_brand,p_type,min(p_partkey) AS f FROM part GROUP BY p_brand,p_type) GROUP BY p_brand")
def ward_types(spark, sf_dir):
    own = rows(spark, sf_dir, "part").withColumnRenamed("p_type", "ward_type")
    return provinces.ward_types(own, "p_brand", "p_partkey").select("p_brand", F.array_join("types", "|").alias("types"))


@query("SELECT p_partkey FROM part WHERE p_type=(SELECT min(p_type) FROM part) AND contains(lower(p_name||' '||p_brand),'1')")
def unit_search_by_type(spark, sf_dir):
    part = rows(spark, sf_dir, "part")
    kind = part.agg(F.min("p_type")).first()[0]
    return profile.search_units(part, ["p_name", "p_brand"], " 1 ", "p_type", kind).select("p_partkey")


def _province_pages(spark, sf_dir) -> DataFrame:
    """A page a nation: its summary object after another one, and narrative texts."""
    n = F.col("n_name")
    q = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    plates = F.when(nation() % 3 == 0, F.lit('"vehicle_license_codes":["11 ",""," 12"],')).when(nation() % 3 == 1, F.lit('"car_plate":"21, 22,,",')).otherwise("")
    summary = F.concat(
        F.lit('{"id":7,"province_name":"Khác","type":"t","province_code":"x","province_name_full":"Tỉnh Khác","short_name":"khac","public_service_id":"9"}{"id":8,"province_name":'), q(n), F.lit(',"type":"t","province_code":"pc","province_name_full":"Tỉnh '), n,
        F.lit('","short_name":'), q(F.lower(n)), F.lit(',"area":"1.234,5","population":"'), (nation() * 1000).cast("string"), F.lit('",'), plates,
        F.when(nation() % 2 == 0, F.lit('"border_description":"bd","leader_bi_thu":"LB","grdp_billion_vnd":"1,5",')).otherwise('"leader_chairman":"LC",'), F.lit('"border_with_provinces":["A","B"],"public_service_id":3}'),
    )
    narrative = F.concat(
        F.lit("<h3 class='x'>Tổng quan về Tỉnh "), n, F.lit("</h3><p>Một <b>đoạn</b>&nbsp;văn.</p><h3>Thông tin hành chính và biên giới</h3><p>Biên giới <br/> dài</p>"),
        F.lit("các biển số xe:<strong class='y'><!-- -->31, 32 <</strong>Bí thư<!-- --> Tỉnh ủy <span>là<strong> <!-- -->Ông N</strong> Chủ tịch UBND <i>là<strong>Bà M</strong>"),
        F.lit('GRDP:</span><span class="font-medium">2.500 tỷ</span>Thu nhập BQ:</span><span class="font-medium">61,5 triệu<h3>Cập nhật theo quyết định sáp nhập 34 tỉnh thành</h3><p class="z"> Mới <i>hơn</i> </p>'),
    )
    meta = F.concat(F.lit('<meta property="og:image" content="http://i/'), n, F.lit('"><meta content="alt" name="og:image:alt">'))
    return rows(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.concat(meta, F.replace(summary, F.lit('"'), F.lit('\\"')), narrative).alias("html"))


@query("SELECT n_nationkey,CASE WHEN n_nationkey=5 THEN 'no summary for nowhere' END AS error,CASE WHEN n_nationkey<>5 THEN 'Tỉnh '||n_name END AS province_name_full,CASE WHEN n_nationkey<>5 THEN 'http://i/'||n_name END AS hero_image_url,CASE WHEN n_nationkey<>5 THEN 'alt' END AS hero_image_alt,CAST(CASE WHEN n_nationkey<>5 THEN 1234.5 END AS DOUBLE) AS area_km2,CASE WHEN n_nationkey<>5 THEN CAST(n_nationkey*1000 AS DOUBLE) END AS population,CASE WHEN n_nationkey=5 THEN NULL WHEN n_nationkey%3=0 THEN '11,12' WHEN n_nationkey%3=1 THEN '21,22' ELSE '31,32' END AS plates,CASE WHEN n_nationkey<>5 THEN 'Một đoạn văn.' END AS overview,CASE WHEN n_nationkey=5 THEN NULL WHEN n_nationkey%2=0 THEN 'bd' ELSE 'Biên giới dài' END AS boundary,CASE WHEN n_nationkey<>5 THEN 'Mới hơn' END AS update_note,CASE WHEN n_nationkey=5 THEN NULL WHEN n_nationkey%2=0 THEN 'LB' ELSE 'Ông N' END AS secretary,CASE WHEN n_nationkey=5 THEN NULL WHEN n_nationkey%2=0 THEN 'Bà M' ELSE 'LC' END AS chairman,CAST(CASE WHEN n_nationkey=5 THEN NULL WHEN n_nationkey%2=0 THEN 1.5 ELSE 2500 END AS DOUBLE) AS grdp,CAST(CASE WHEN n_nationkey<>5 THEN 61.5 END AS DOUBLE) AS income,CASE WHEN n_nationkey<>5 THEN 'A,B' END AS borders FROM nation")
def province_snapshots(spark, sf_dir):
    slug = F.when(nation() == 5, "nowhere").otherwise(F.lower("n_name"))
    found = _province_pages(spark, sf_dir).select("n_nationkey", etl.snapshot(F.col("html"), F.col("n_name"), slug, F.lit("s")).alias("s"))
    s = F.col("s")
    return found.select(
        "n_nationkey", "s.error", "s.province_name_full", "s.hero_image_url", "s.hero_image_alt", "s.area_km2", "s.population", F.array_join(s["vehicle_plates"], ",").alias("plates"), s["overview_summary"].alias("overview"),
        s["boundary_summary"].alias("boundary"), "s.update_note", "s.secretary", "s.chairman", s["grdp_billion_vnd"].alias("grdp"), s["income_per_capita_million_vnd"].alias("income"), F.array_join(s["border_with_provinces"], ",").alias("borders"),
    )


_META = ['<meta property="og:image" content=" {u} "/>', '<META content="{u}" x property="og:image">', '<meta name="og:image" content=""><meta name="og:image" id="1" content="{u}">', '<meta content="n" name="og:image"><meta content="{u}" property="og:image">', '<meta property="ogximage" content="{u}">']


@query("SELECT page_id,CASE WHEN page_id%5<>4 THEN url END AS image FROM pages")
def meta_contents(spark, sf_dir):
    page = F.replace(pick(_META, F.col("page_id")), F.lit("{u}"), F.col("url"))
    return rows(spark, sf_dir, "pages").select("page_id", text.meta_content(F.concat(F.substring("html", 1, 80), page), "og:image").alias("image"))


@query("SELECT page_id,CASE page_id%4 WHEN 0 THEN 'Đoạn '||page_id WHEN 1 THEN 'a b' END AS paragraph FROM pages")
def section_paragraphs(spark, sf_dir):
    i = F.col("page_id")
    page = F.when(i % 4 == 0, F.concat(F.lit("<h3 id='1'>A.(b)</h3><p> Đoạn<br>"), i, F.lit("</p>"))).when(i % 4 == 1, "<h3>A.(b)</h3><p>a<!-- c -->b</p><h3>A.(b)</h3><p>no</p>").when(i % 4 == 2, "<h3>Ax(b)</h3><p>x</p>").otherwise("<h3>A.(b)</h3> <p>x</p>")
    return rows(spark, sf_dir, "pages").select("page_id", text.section_paragraph(page, "A.(b)").alias("paragraph"))


_BOXES = "commune(ord,code,name,type,province,aliases,w,s,e,n)"


@query(f"WITH {COMMUNE_SQL} SELECT 'FeatureCollection' AS collection,CAST(ord-1 AS INT) AS place,code AS commune_code,name AS commune_name,type AS commune_type,province AS province_code,w AS west,n AS north,1 AS polygons FROM commune")
def commune_geojson(spark, sf_dir):
    text_ = files.collection_json(files.commune_features(spark), ["commune_code", "commune_name", "commune_type", "province_code"], "ord")
    get = lambda f: F.try_variant_get("properties", f"$.{f}", "string").alias(f)
    ring = F.col("geometry")[0][0]
    found = seeds.checked_features(files.features_of(text_), 12)
    return found.select("collection", F.col("ord").alias("place"), *[get(f) for f in ("commune_code", "commune_name", "commune_type", "province_code")], ring[0]["lon"].alias("west"), ring[2]["lat"].alias("north"), F.size("geometry").alias("polygons"))


@query("SELECT 'provinces' AS name,34 AS n UNION ALL SELECT 'communes',12")
def seed_checks(spark, sf_dir):
    count = lambda df, name: df.agg(F.lit(name).alias("name"), F.count("*").cast("int").alias("n"))
    return count(seeds.checked_provinces(spark), "provinces").unionByName(count(seeds.checked_communes(spark), "communes"))


# ---- display, requests and texts ----


def vi_sql(x: str, digits: int) -> str:
    own = f"format('{{:,.{digits}f}}',round(CAST({x} AS DECIMAL(30,8)),{digits}))"
    return f"replace(replace(replace(regexp_replace(regexp_replace({own},'(\\.[0-9]*?)0+$','\\1'),'\\.$',''),',','#'),'.',','),'#','.')"


@query(f"SELECT c_custkey,coalesce({vi_sql('b', 2)}||' km²','Chưa có dữ liệu') AS area,coalesce({vi_sql('b', 3)}||' người','Chưa có dữ liệu') AS population,coalesce({vi_sql('b', 3)}||' tỷ VNĐ','Chưa có dữ liệu') AS currency,coalesce({vi_sql('b', 1)}||' triệu VNĐ/người','Chưa có dữ liệu') AS income,coalesce({vi_sql('b', 2)}||' người/km²','Chưa có dữ liệu') AS density FROM (SELECT c_custkey,CASE WHEN c_custkey%9<>0 THEN c_acctbal*1000 END AS b FROM customer)")
def display_values(spark, sf_dir):
    b = F.when(key() % 9 != 0, F.col("c_acctbal") * 1000)
    return customers(spark, sf_dir, numeric.area(b).alias("area"), numeric.population(b).alias("population"), numeric.currency(b).alias("currency"), numeric.income(b).alias("income"), numeric.people_per_km2(b).alias("density"))


_CENTRES = ["Hồ Chí Minh City", "Huế, Huế City,", "TP. Vinh , ", "", None, "Phường A, tỉnh B", " , "]
_SHOWN = [("Thành phố Hồ Chí Minh", "Thành phố Hồ Chí Minh"), ("Huế,Thành phố Huế", "Huế,Thành phố Huế,"), ("TP Vinh", "TP Vinh"), (text.NO_DATA, None), (text.NO_DATA, None), ("Phường A, tỉnh B", "Phường A"), (text.NO_DATA, " , ")]


@query(f"WITH {values('c', 'i,page,card', [(i, *s) for i, s in enumerate(_SHOWN)])} SELECT c_custkey,page,card FROM customer JOIN c ON i=c_custkey%{len(_CENTRES)}")
def administrative_centres(spark, sf_dir):
    raw = pick(_CENTRES, key())
    return customers(spark, sf_dir, text.administrative_centre(raw).alias("page"), text.administrative_centre(raw, True).alias("card"))


@query(f"SELECT doc_id,CASE WHEN length(t)>40 THEN left(t,38)||'…' ELSE t END AS sample FROM (SELECT doc_id,left(text,CAST(30+doc_id%20 AS INT)) AS t FROM documents)")
def ellipses(spark, sf_dir):
    return rows(spark, sf_dir, "documents").select("doc_id", text.ellipsis(F.left("text", (30 + F.col("doc_id") % 20).cast("int"))).alias("sample"))


@query(f"WITH {NAMES_SQL} SELECT c_custkey,trim(regexp_replace(raw,'^(tỉnh|thành phố|thị xã|thành thị|quận|huyện|thị trấn|phường|xã)\\s+','','i')) AS bare,contains({_STRIP('raw')},'hà') OR contains('hà',{_STRIP('raw')}) AS matched FROM name")
def admin_prefixes(spark, sf_dir):
    raw = F.col("raw")
    return names(spark, sf_dir).select("c_custkey", text.strip_admin_prefix(raw).alias("bare"), text.name_matches(raw, F.lit("Xã HÀ")).alias("matched"))


@query(f"WITH {points_sql()} SELECT c_custkey,round(lat/7,5) AS box,round(lon/7,6) AS click,printf('%.4f',lat/7) AS shown FROM point")
def fixed_decimals(spark, sf_dir):
    lat, lon = F.col("lat") / 7, F.col("lon") / 7
    return points(spark, sf_dir).select("c_custkey", numeric.to_fixed(lat, 5).alias("box"), numeric.to_fixed(lon, 6).alias("click"), numeric.fixed_text(lat, 4).alias("shown"))


_RAW = [None, "", " ", "12.5", " 7 ", "x", "1e2", "-", "0x", "12,5", "-3."]
_COERCED = [0.0, 0.0, 0.0, 12.5, 7.0, None, 100.0, None, None, None, -3.0]


@query(f"WITH {values('c', 'i,number', list(enumerate(_COERCED)))} SELECT c_custkey,CAST(number AS DOUBLE) AS number,CASE WHEN c_custkey%{len(_RAW)}=4 THEN '7' WHEN c_custkey%{len(_RAW)}=2 THEN '' ELSE {pick_sql(_RAW, 'c_custkey')} END AS trimmed FROM customer JOIN c ON i=c_custkey%{len(_RAW)}")
def request_inputs(spark, sf_dir):
    raw = pick(_RAW, key())
    return customers(spark, sf_dir, numeric.coerced(raw).alias("number"), text.trimmed_input(raw).alias("trimmed"))


@query(f"WITH {NAMES_SQL} SELECT c_custkey,'https://maps.example/search?q='||url_encode(raw) AS url,'https://maps.example/style.json?apikey=k'||c_custkey AS style FROM name")
def request_urls(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", text.with_query(F.lit("https://maps.example/search"), q=F.col("raw")).alias("url"), text.with_query(F.lit("https://maps.example/style.json"), apikey=F.concat(F.lit("k"), key())).alias("style"))


@query("SELECT c_custkey,c_custkey%3=0 AS is_object,CAST(CASE WHEN c_custkey%3=1 THEN c_custkey%4 ELSE 0 END AS INT) AS n_items FROM customer")
def payload_guards(spark, sf_dir):
    items = F.array_join(F.transform(F.sequence(F.lit(0), (key() % 4).cast("int")), lambda i: i.cast("string")), ",")
    doc = F.try_parse_json(F.when(key() % 3 == 0, '{"a":1}').when((key() % 3 == 1) & (key() % 4 == 0), "[]").when(key() % 3 == 1, F.concat(F.lit("["), F.regexp_replace(items, "^0,", ""), F.lit("]"))).otherwise("7"))
    return customers(spark, sf_dir, text.object_or_null(doc).isNotNull().alias("is_object"), F.size(text.array_or_empty(doc)).alias("n_items"))


@query("SELECT o_orderkey,nullif(o_orderstatus,'O') AS shown FROM orders")
def blank_addresses(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", text.blank_as_null(F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus"))).alias("shown"))


@query("SELECT c_custkey,'a|b'||c_custkey AS listed,CASE WHEN c_custkey%2=0 THEN 'x|y z' ELSE '' END AS quoted FROM customer")
def parsed_lists(spark, sf_dir):
    listed = text.split_list(F.concat(F.lit(" a ,, b"), key(), F.lit(" , ")))
    quoted = text.quoted_list(F.when(key() % 2 == 0, '["x", "y z"]'))
    return customers(spark, sf_dir, F.array_join(listed, "|").alias("listed"), F.array_join(quoted, "|").alias("quoted"))


@query("WITH d AS (SELECT *,row_number() OVER (PARTITION BY source ORDER BY n_chars DESC,doc_id) AS rn FROM documents) SELECT source,string_agg('Tiêu đề: '||doc_id||' '||chr(10)||'Nội dung: '||coalesce(lang,'-'),chr(10)||chr(10) ORDER BY rn) AS context FROM d WHERE rn<=5 GROUP BY source")
def news_contexts(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = rows(spark, sf_dir, "documents").withColumn("rn", F.row_number().over(w)).where("rn <= 7")
    hit = F.struct("rn", F.col("doc_id").cast("string").alias("title"), F.coalesce("lang", F.lit("-")).alias("description"))
    return top.groupBy("source").agg(knowledge.news_context(F.array_sort(F.collect_list(hit))).alias("context"))


@query("WITH u AS (SELECT conv_id,arg_max(text,struct_pack(turn,text)) AS message FROM conversations WHERE role='user' AND text IS NOT NULL GROUP BY conv_id) SELECT conv_id,md5('Quy tắc.'||chr(10)||chr(10)||'--- TÀI LIỆU (TXT): a.txt ---'||chr(10)||'Một.'||chr(10)||chr(10)||'--- TÀI LIỆU (PDF): b.pdf ---'||chr(10)||'Hai.') AS system_md5,md5(message) AS user_md5 FROM u")
def prompts(spark, sf_dir):
    parts = spark.createDataFrame([("PDF", "b.pdf", "Hai."), ("TXT", "a.txt", "Một.")], "kind string, file_name string, text string")
    base = files.knowledge_base(parts.select("file_name", knowledge.knowledge_part(F.col("kind"), F.col("file_name"), F.col("text")).alias("part")))
    last = rows(spark, sf_dir, "conversations").where("role = 'user' and text is not null").groupBy("conv_id").agg(F.max_by("text", F.struct("turn", "text")).alias("message"))
    sent = last.join(F.broadcast(base), F.lit(True)).select("conv_id", knowledge.prompt("Quy tắc.", F.col("knowledge"), F.col("message")).alias("m"))
    return sent.select("conv_id", F.md5(F.col("m")[0]["content"]).alias("system_md5"), F.md5(F.col("m")[1]["content"]).alias("user_md5"))


def _enrichment(spark, sf_dir, first: int | None = None) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey")
    file = F.concat(F.lpad(k.cast("string"), 2, "0"), F.lit("_"), n, F.lit(".json"))
    doc = F.when(k % 7 == 3, "{bad").otherwise(F.concat(F.lit('﻿{"name":{"value":"'), n, F.lit('"},"environmental_data":{"old":1}}')))
    answer = F.when(k % 5 == 0, '{"tinh_hinh_rung":"r","tinh_hinh_bien":"b"}').otherwise(F.concat(F.lit('{"tinh_hinh_rung":"rừng '), k, F.lit('","tinh_hinh_bien":"Không có biển","o_nhiem_tong_hop":"ít"}')))
    nation = rows(spark, sf_dir, "nation")
    docs, answers = nation.select(file.alias("file_name"), doc.alias("doc")), nation.where("n_nationkey % 4 <> 1").select(file.alias("file_name"), answer.alias("answer"))
    found = knowledge.enrich(docs, answers, F.lit("2025-07-01T00:00:00.000Z"), first)
    doc = F.try_parse_json("doc")
    get = lambda p: F.try_variant_get(doc, p, "string")
    return found.select("province_name", F.col("step").cast("long").alias("step"), "total", "error", F.when(F.col("error").isNull(), get("$.environmental_data.tinh_hinh_rung")).alias("forest"), F.when(F.col("error").isNull(), get("$.environmental_data.old")).alias("old"), F.when(F.col("error").isNull(), get("$.environmental_data.last_updated")).alias("stamp"), F.when(F.col("error").isNull(), get("$.name.value")).alias("name"))


_ENRICHED = "SELECT n_name AS province_name,n_nationkey+1 AS step,count(*) OVER () AS total,e AS error,CASE WHEN e IS NULL THEN 'rừng '||n_nationkey END AS forest,CAST(NULL AS VARCHAR) AS old,CASE WHEN e IS NULL THEN '2025-07-01T00:00:00.000Z' END AS stamp,CASE WHEN e IS NULL THEN n_name END AS name FROM (SELECT *,CASE WHEN n_nationkey%7=3 THEN 'document is not JSON' WHEN n_nationkey%4=1 THEN 'no answer' WHEN n_nationkey%5=0 THEN 'answer is not sound' END AS e FROM nation)"


@query(f"SELECT * REPLACE (CAST(step AS BIGINT) AS step) FROM ({_ENRICHED})")
def enrichment(spark, sf_dir):
    return _enrichment(spark, sf_dir)


@query(f"SELECT * REPLACE (CAST(step AS BIGINT) AS step) FROM ({_ENRICHED}) WHERE step<=2")
def enrichment_of_first_files(spark, sf_dir):
    return _enrichment(spark, sf_dir, 2)


@query("SELECT page_id,md5(replace('<'||url||'>','.','')) AS shown_md5 FROM pages")
def response_bodies(spark, sf_dir):
    body = files.response(F.lit(200), F.struct(F.concat(F.lit("<"), F.replace("url", F.lit("."), F.lit("")), F.lit(">")).alias("url")))
    return rows(spark, sf_dir, "pages").select("page_id", F.md5(F.get_json_object(body["body"], "$.url")).alias("shown_md5"))


# ---- forms of the tables' own values ----


@query("SELECT o_orderkey,round(o_totalprice,2) AS number FROM orders")
def numbers_as_shown_and_read(spark, sf_dir):
    shown_ = numeric.format_vi(F.col("o_totalprice"), 2)
    return rows(spark, sf_dir, "orders").select("o_orderkey", numeric.parse_numeric(shown_, True).alias("number"))


@query("SELECT c_custkey,CASE WHEN c_custkey%4<>0 THEN 'phường '||c_name END AS commune,CASE WHEN c_custkey%3<>0 THEN 'Huyện  '||c_mktsegment END AS district,CASE WHEN c_custkey%5=0 THEN 'thành phố '||n_name ELSE 'Tỉnh '||n_name END AS province FROM customer JOIN nation ON n_nationkey=c_nationkey")
def address_parts(spark, sf_dir):
    c, n = rows(spark, sf_dir, "customer"), F.broadcast(rows(spark, sf_dir, "nation"))
    where = F.when(key() % 5 == 0, F.concat(F.lit("thành phố "), "n_name")).otherwise(F.concat(F.lit("thành phố X, Tỉnh "), "n_name"))
    written = F.concat_ws(", ", F.lit("Số 1 phường Y"), F.when(key() % 4 != 0, F.concat(F.lit("phường "), "c_name")), F.when(key() % 3 != 0, F.concat(F.lit("Huyện  "), "c_mktsegment")), where, F.lit("Việt Nam"))
    found = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", address.parts(address.split_terms(written)).alias("x"))
    return found.select("c_custkey", "x.*")


@query("SELECT s_suppkey,s_name AS administrative_code,CASE WHEN s_suppkey%4<>0 THEN s_acctbal END AS population,CASE WHEN s_suppkey%3=0 THEN 2 ELSE 1 END AS n_infrastructure,s_suppkey%7<>6 AS has_profile FROM supplier WHERE s_suppkey%7<>6 UNION ALL SELECT s_suppkey,NULL,NULL,0,FALSE FROM supplier WHERE s_suppkey%7=6")
def profile_documents(spark, sf_dir):
    k = F.col("s_suppkey")
    leaf = lambda v: F.struct(v.alias("value"))
    doc = F.struct(leaf(F.col("s_name")).alias("administrative_code"), F.struct(leaf(F.when(k % 4 != 0, F.col("s_acctbal"))).alias("total")).alias("population"), F.struct(leaf(F.when(k % 3 == 0, F.array(F.lit("cảng")))).alias("seaport"), leaf(F.array(F.col("s_name"))).alias("airport")).alias("infrastructure"))
    written = F.when(k % 7 == 6, F.concat(F.to_json(doc), F.lit("}"))).otherwise(F.concat(F.lit("\ufeff"), F.to_json(doc)))
    name = k.cast("string")
    docs = rows(spark, sf_dir, "supplier").select(name.alias("file_name"), name.alias("name_key"), text.strict_json(text.strip_bom(written)).alias("doc"))
    return profile.profile(docs).select(F.col("file_name").cast("long").alias("s_suppkey"), "administrative_code", "population", F.size("infrastructure").alias("n_infrastructure"), "has_profile")
