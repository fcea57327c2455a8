"""Registered queries of the address-resolution engine and their SQL equivalents over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import geo, lookup, numeric, text
from tessera.operators import address, profile, resolve
from tessera.sources import seeds

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL forms of the reference tables and of the text functions ----


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    if isinstance(v, list):
        return "[" + ",".join(lit(x) for x in v) + "]"
    return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else (f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v))


def values(name: str, columns: str, data: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ",".join("(" + ",".join(lit(v) for v in r) + ")" for r in data) + ")"


PROVINCE_SQL = values("province", "ord,code,name,kind,aliases,w,s,e,n", [(i, *p) for i, p in enumerate(seeds.PROVINCES, 1)])
COMMUNE_SQL = values("commune", "ord,code,name,type,province,aliases,w,s,e,n", seeds.strips())
LEGACY_SQL = values("legacy", "ord,name,code", [(i, *p) for i, p in enumerate(seeds.LEGACY_PROVINCES, 1)])
LEGACY_COMMUNE_SQL = values("legacy_commune", "ord,commune,district,province,code,mapping,is_default", [(i, *p) for i, p in enumerate(seeds.LEGACY_COMMUNES, 1)])
ZONE_SQL = values("zone", "ord,zone,s,n,w,e,current_commune,current_province,legacy_commune,legacy_district,legacy_province", [(i, *z) for i, z in enumerate(seeds.ZONES, 1)])


def fold_sql(x: str) -> str:
    return f"replace(replace(strip_accents({x}),'đ','d'),'Đ','D')"


def norm_sql(x: str) -> str:
    out = f"trim(regexp_replace(regexp_replace(lower({fold_sql(f'coalesce({x},{lit('')})')}),'[().,/-]',' ','g'),'\\s+',' ','g'))"
    for p in text.PREFIXES:
        out = f"regexp_replace({out},'^{p} ','')"
    return out


# Points whose resolution is known, as latitude and longitude.
GOLDEN = [(10.7769, 106.7009), (10.97, 106.735), (16.05, 108.24), (16.46, 107.605), (21.06, 105.83), (9.98, 105.76), (10.025, 105.79), (20.2, 107.0), (9.9, 105.03), (10.65, 105.5), (21.12, 105.5), (14.0, 108.0), (0.0, 0.0), (95.0, 106.0)]


def points(spark: SparkSession, sf_dir: str, golden: bool = False) -> DataFrame:
    k = F.col("c_custkey")
    lat = (F.lit(800) + (k * 7919) % 1550).cast("double") / 100
    lon = (F.lit(10200) + (k * 104729) % 760).cast("double") / 100
    if golden:
        at = (k % 40 + 1).cast("int")
        lat = F.coalesce(F.get(F.array(*[F.lit(p[0]) for p in GOLDEN]), at - 1), lat)
        lon = F.coalesce(F.get(F.array(*[F.lit(p[1]) for p in GOLDEN]), at - 1), lon)
    return rows(spark, sf_dir, "customer").select("c_custkey", lat.alias("lat"), lon.alias("lon"))


def points_sql(golden: bool = False) -> str:
    lat, lon = "CAST(800+(c_custkey*7919)%1550 AS DOUBLE)/100", "CAST(10200+(c_custkey*104729)%760 AS DOUBLE)/100"
    if golden:
        lat = "CASE c_custkey%40 " + " ".join(f"WHEN {i} THEN {lit(p[0])}" for i, p in enumerate(GOLDEN)) + f" ELSE {lat} END"
        lon = "CASE c_custkey%40 " + " ".join(f"WHEN {i} THEN {lit(p[1])}" for i, p in enumerate(GOLDEN)) + f" ELSE {lon} END"
    return f"point AS (SELECT c_custkey,{lat} AS lat,{lon} AS lon FROM customer)"


LOCATED_SQL = "located AS (SELECT p.c_custkey,p.lat,p.lon,arg_min(v.code,v.ord) AS province_code FROM point p LEFT JOIN province v ON p.lon BETWEEN v.w AND v.e AND p.lat BETWEEN v.s AND v.n GROUP BY ALL)"


@query(f"WITH {PROVINCE_SQL},{points_sql()},{LOCATED_SQL} SELECT * FROM located")
def point_province_bbox(spark, sf_dir):
    return points(spark, sf_dir).withColumn("province_code", lookup.province_at(F.col("lat"), F.col("lon")))


@query(f"WITH {PROVINCE_SQL},{points_sql()},{LOCATED_SQL} SELECT v.ord,v.code AS province_code,count(l.c_custkey) AS n_points FROM province v LEFT JOIN located l ON l.province_code=v.code GROUP BY ALL")
def point_province_count(spark, sf_dir):
    found = points(spark, sf_dir).select(lookup.province_at(F.col("lat"), F.col("lon")).alias("province")).groupBy("province").agg(F.count("*").alias("n"))
    p = seeds.provinces(spark)
    return p.join(found, p["province_code"] == found["province"], "left").select("ord", "province_code", F.coalesce("n", F.lit(0)).cast("long").alias("n_points")).orderBy("ord")


@query(f"WITH {PROVINCE_SQL},{COMMUNE_SQL},{points_sql(True)},{LOCATED_SQL} SELECT l.c_custkey,l.province_code,arg_min(c.code,c.ord) AS commune_code FROM located l LEFT JOIN commune c ON c.province=l.province_code AND l.lon BETWEEN c.w AND c.e AND l.lat BETWEEN c.s AND c.n GROUP BY ALL")
def point_commune_strip(spark, sf_dir):
    located = points(spark, sf_dir, True).withColumn("province_code", lookup.province_at(F.col("lat"), F.col("lon")))
    return located.select("c_custkey", "province_code", lookup.commune_at(F.col("lat"), F.col("lon"), F.col("province_code")).alias("commune_code"))


_RING = [(103.0, 10.0), (108.0, 10.0), (108.0, 14.0), (106.0, 14.0), (106.0, 20.0), (103.0, 20.0), (103.0, 10.0)]
_EDGES = values("edge", "ax,ay,bx,b_y", [(*a, *b) for a, b in zip(_RING, _RING[1:], strict=False)])


@query(f"WITH {_EDGES},{points_sql()} SELECT c_custkey,(sum(CASE WHEN (ay>lat)<>(b_y>lat) THEN CASE WHEN lon<(bx-ax)*(lat-ay)/(b_y-ay)+ax THEN 1 ELSE 0 END ELSE 0 END)%2=1) OR max(CASE WHEN (bx-ax)*(lat-ay)-(b_y-ay)*(lon-ax)=0 AND lon BETWEEN least(ax,bx) AND greatest(ax,bx) AND lat BETWEEN least(ay,b_y) AND greatest(ay,b_y) THEN 1 ELSE 0 END)=1 AS inside FROM point,edge GROUP BY c_custkey")
def point_polygon_raycast(spark, sf_dir):
    ring = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in _RING])
    return points(spark, sf_dir).select("c_custkey", geo.in_ring(ring, F.col("lon"), F.col("lat")).alias("inside"))


@query(f"WITH {ZONE_SQL},{points_sql(True)} SELECT p.c_custkey,coalesce(arg_min(z.zone,z.ord),'fallback') AS zone,arg_min(z.current_commune,z.ord) AS current_commune FROM point p LEFT JOIN zone z ON p.lat BETWEEN z.s AND z.n AND p.lon BETWEEN z.w AND z.e GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY p.c_custkey"))
def zone_lookup_default(spark, sf_dir):
    at = resolve.recorded_zone(F.col("lat"), F.col("lon"))["current"]
    return points(spark, sf_dir, True).select("c_custkey", at["payload"].alias("zone"), at["commune"].alias("current_commune"))


@query("WITH t AS (SELECT o_orderkey, CASE o_orderkey%5 WHEN 0 THEN 'x' WHEN 1 THEN '' ELSE CAST(CAST(o_orderkey%240 AS DOUBLE)-120 AS VARCHAR) END AS raw FROM orders), v AS (SELECT o_orderkey, TRY_CAST(raw AS DOUBLE) AS lat FROM t) SELECT o_orderkey, lat, coalesce(lat BETWEEN -90 AND 90,FALSE) AS valid FROM v")
def coord_validation(spark, sf_dir):
    k = F.col("o_orderkey")
    raw = F.when(k % 5 == 0, "x").when(k % 5 == 1, "").otherwise(((k % 240).cast("double") - 120).cast("string"))
    lat = F.when(raw.rlike(r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"), raw.try_cast("double"))
    return rows(spark, sf_dir, "orders").select("o_orderkey", lat.alias("lat")).withColumn("valid", geo.valid_coordinates(F.col("lat"), F.lit(0.0)))


@query(f"SELECT doc_id, md5(lower({fold_sql('text')})) AS folded_md5 FROM documents")
def normalize_documents(spark, sf_dir):
    return rows(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_search(F.col("text"))).alias("folded_md5"))


# Raw names that the derived requests cycle through.
NAME_PREFIXES = ["Tỉnh ", "tỉnh  ", "Thành phố ", "TP. ", "", "Phường ", "Xã ", "Thị xã ", "Đặc khu "]
NAMES = ["Hà Nội", "Bình Dương", "Bà Rịa - Vũng Tàu", "Thừa Thiên - Huế", "Sài Gòn", "Bắc Kạn", "Ho Chi Minh City", "Đắk Lắk", "Ba Đình", "Phú Hòa", "Ben Thanh Ward", "Hải", "Phú Hội Hương Thủy", "Hương Thủy", "Xyz", "Tỉnh Xã X"]


def names(spark, sf_dir) -> DataFrame:
    k = F.col("c_custkey")
    pick = lambda xs, n: F.get(F.array(*[F.lit(x) for x in xs]), n.cast("int"))
    return rows(spark, sf_dir, "customer").select(
        "c_custkey",
        F.concat(pick(NAME_PREFIXES, k % len(NAME_PREFIXES)), pick(NAMES, k % len(NAMES))).alias("raw"),
        pick([p[0] for p in seeds.PROVINCES], F.floor(k / 7) % 34).alias("province"),
    )


NAMES_SQL = f"name AS (SELECT c_custkey,list_extract({lit(NAME_PREFIXES)},CAST(c_custkey%{len(NAME_PREFIXES)} AS INT)+1)||list_extract({lit(NAMES)},CAST(c_custkey%{len(NAMES)} AS INT)+1) AS raw,list_extract({lit([p[0] for p in seeds.PROVINCES])},CAST((c_custkey//7)%34 AS INT)+1) AS province FROM customer)"


@query(f"WITH {NAMES_SQL} SELECT c_custkey,raw,{norm_sql('raw')} AS norm FROM name")
def normalize_admin_names(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", "raw", text.normalize_admin_name(F.col("raw")).alias("norm"))


KEYS_SQL = f"keyed AS (SELECT 0 AS tier,ord,{norm_sql('name')} AS norm,code FROM legacy UNION ALL SELECT 1,ord*100,{norm_sql('name')},code FROM province UNION ALL SELECT 1,ord*100+i,{norm_sql('alias')},code FROM (SELECT ord,code,unnest(aliases) AS alias,generate_subscripts(aliases,1) AS i FROM province)), keys AS (SELECT norm,arg_min(code,tier*100000+ord) AS code FROM keyed GROUP BY norm)"


@query(f"WITH {PROVINCE_SQL},{LEGACY_SQL},{NAMES_SQL},{KEYS_SQL} SELECT c_custkey,raw,k.code AS province_code FROM name LEFT JOIN keys k ON k.norm={norm_sql('raw')}")
def province_crosswalk(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", "raw", lookup.province_of_name(F.col("raw")).alias("province_code"))


@query(f"WITH {PROVINCE_SQL},{COMMUNE_SQL},a AS (SELECT 'province' AS entity_type,code AS entity_code,name AS raw_name FROM province UNION ALL SELECT 'province',code,unnest(aliases) FROM province UNION ALL SELECT 'commune',code,name FROM commune UNION ALL SELECT 'commune',code,unnest(aliases) FROM commune) SELECT *,{norm_sql('raw_name')} AS normalized_name FROM a")
def alias_explode_union(spark, sf_dir):
    return resolve.aliases(spark)


LADDER_SQL = f"""cn AS (SELECT ord,code,province,{norm_sql('name')} AS norm FROM commune), ca AS (SELECT DISTINCT code,{norm_sql('alias')} AS alias FROM (SELECT code,unnest(list_concat([name],aliases)) AS alias FROM commune)),
hit AS (SELECT a.*,c.ord,c.code,CASE WHEN a.norm='' OR c.code IS NULL THEN NULL WHEN c.norm=a.norm THEN 1 WHEN EXISTS (SELECT 1 FROM ca WHERE ca.code=c.code AND ca.alias=a.norm) THEN 2 WHEN contains(c.norm,a.norm) OR contains(a.norm,c.norm) THEN 3 END AS t FROM ask a LEFT JOIN cn c ON c.province=a.province),
best AS (SELECT *,min(t) OVER (PARTITION BY c_custkey) AS bt,count(code) OVER (PARTITION BY c_custkey) AS n,row_number() OVER (PARTITION BY c_custkey ORDER BY ord) AS rn FROM hit),
ladder AS (SELECT c_custkey,any_value(province) AS province,CASE WHEN any_value(province) IS NULL THEN 'skipped' WHEN max(n)=0 THEN 'no_candidates' WHEN min(bt)=1 THEN 'exact' WHEN min(bt)=2 THEN 'alias' WHEN min(bt)=3 THEN 'fuzzy' ELSE 'none' END AS tier,
CASE WHEN count(*) FILTER (WHERE t=bt)=1 THEN min(code) FILTER (WHERE t=bt) END AS matched,
coalesce(CASE WHEN min(bt) IS NULL THEN string_agg(code,',' ORDER BY ord) FILTER (WHERE rn<=3) WHEN count(*) FILTER (WHERE t=bt)>1 THEN string_agg(code,',' ORDER BY ord) FILTER (WHERE t=bt) END,'') AS alternatives FROM best GROUP BY c_custkey)"""


@query(f"WITH {COMMUNE_SQL},{NAMES_SQL},ask AS (SELECT c_custkey,province,{norm_sql('raw')} AS norm FROM name),{LADDER_SQL} SELECT * FROM ladder")
def commune_ladder(spark, sf_dir):
    found = names(spark, sf_dir).withColumn("x", lookup.commune_ladder(F.col("province"), F.col("raw")))
    return found.select("c_custkey", "province", "x.tier", F.col("x.match").alias("matched"), F.array_join(F.transform("x.alternatives", lambda a: a["commune_code"]), ",").alias("alternatives"))


_TRIPLES = [("Phường Phú Hòa", None, None), ("phường phú hòa", "Quận 1", None), ("Thị xã Hương Thủy", "bất kỳ", "Huế"), (None, "x", "y"), ("Phường Bến Nghé", "Quận 1", ""), ("Phường 1", None, "Sóc Trăng"), ("Phường Hòa Hải", "", "Hà Nội")]
_TRIPLE_SQL = values("triple", "i,c,d,p", [(i, *t) for i, t in enumerate(_TRIPLES)])
_LOOSE = lambda a, b: f"({norm_sql(a)}='' OR {norm_sql(b)}='' OR {norm_sql(a)}={norm_sql(b)})"


@query(f"WITH {LEGACY_COMMUNE_SQL},{_TRIPLE_SQL},x AS (SELECT t.i,arg_min(m.code,m.ord) AS crosswalk FROM triple t LEFT JOIN legacy_commune m ON m.is_default AND {norm_sql('t.c')}<>'' AND {norm_sql('t.c')}={norm_sql('m.commune')} AND {_LOOSE('t.d', 'm.district')} AND {_LOOSE('t.p', 'm.province')} GROUP BY t.i) SELECT c_custkey,x.crosswalk FROM customer JOIN x ON x.i=c_custkey%{len(_TRIPLES)}")
def legacy_commune_crosswalk(spark, sf_dir):
    k = (F.col("c_custkey") % len(_TRIPLES)).cast("int")
    part = lambda j: F.get(F.array(*[F.lit(t[j]).cast("string") for t in _TRIPLES]), k)
    return rows(spark, sf_dir, "customer").select("c_custkey", lookup.legacy_crosswalk(part(0), part(1), part(2)).alias("crosswalk"))


@query(f"""WITH {PROVINCE_SQL},{COMMUNE_SQL},{LEGACY_SQL},{LEGACY_COMMUNE_SQL},{ZONE_SQL},{KEYS_SQL},{points_sql(True)},{LOCATED_SQL},
g AS (SELECT l.c_custkey,l.lat,l.lon,l.province_code AS pp,l.lat BETWEEN -90 AND 90 AND l.lon BETWEEN -180 AND 180 AS valid,arg_min(z.current_commune,z.ord) AS cc,arg_min(z.current_province,z.ord) AS cp,arg_min(z.legacy_commune,z.ord) AS lc,arg_min(z.legacy_district,z.ord) AS ld,arg_min(z.legacy_province,z.ord) AS lp FROM located l LEFT JOIN zone z ON l.lat BETWEEN z.s AND z.n AND l.lon BETWEEN z.w AND z.e GROUP BY l.c_custkey,l.lat,l.lon,l.province_code),
h AS (SELECT g.*,k.code AS np,CASE WHEN valid THEN coalesce(pp,k.code) END AS province FROM g LEFT JOIN keys k ON k.norm={norm_sql('g.cp')}),
pc AS (SELECT h.c_custkey,arg_min(c.code,c.ord) AS poly FROM h LEFT JOIN commune c ON c.province=h.province AND h.lon BETWEEN c.w AND c.e AND h.lat BETWEEN c.s AND c.n GROUP BY h.c_custkey),
ask AS (SELECT c_custkey,province,{norm_sql('cc')} AS norm FROM h),{LADDER_SQL},
lx AS (SELECT h.c_custkey,arg_min(m.code,m.ord) AS crosswalk FROM h LEFT JOIN legacy_commune m ON m.is_default AND {norm_sql('h.lc')}<>'' AND {norm_sql('h.lc')}={norm_sql('m.commune')} AND {_LOOSE('h.ld', 'm.district')} AND {_LOOSE('h.lp', 'm.province')} GROUP BY h.c_custkey)
SELECT h.c_custkey,h.province AS province_code,CASE WHEN valid THEN coalesce(matched,CASE WHEN cc IS NULL THEN poly END,crosswalk) END AS commune_code,CASE WHEN NOT valid THEN 'error' WHEN h.province IS NULL THEN 'low' WHEN matched IS NOT NULL THEN 'high' WHEN (cc IS NULL AND poly IS NOT NULL) OR cc IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence,poly IS NOT NULL AS polygon_commune,valid AND matched IS NULL AND NOT (cc IS NULL AND poly IS NOT NULL) AND crosswalk IS NOT NULL AS crosswalk_used,coalesce(pp<>np,FALSE) AS conflict FROM h JOIN pc USING (c_custkey) JOIN ladder USING (c_custkey) JOIN lx USING (c_custkey)""")
def resolve_confidence(spark, sf_dir):
    return resolve.flat(resolve.resolve(points(spark, sf_dir, True))).select("c_custkey", "province_code", "commune_code", "confidence", "polygon_commune", "crosswalk_used", "conflict")


_ADDRESSES = ["134 Đường Phú Lợi, phường Phú Hòa, thành phố Thủ Dầu Một, tỉnh Bình Dương", "Quận 1, Thành phố Hồ Chí Minh", "thành phố Huế, thành phố Đà Nẵng", "đặc khu Phú Quốc, An Giang", "xã Hòa Vang, huyện Hòa Vang, thành phố Đà Nẵng", ""]
_EXPECTED = [("phường Phú Hòa", None, "tỉnh Bình Dương"), (None, "Quận 1", "Thành phố Hồ Chí Minh"), (None, None, "thành phố Đà Nẵng"), (None, None, None), ("xã Hòa Vang", "huyện Hòa Vang", "thành phố Đà Nẵng"), (None, None, None)]


@query(f"WITH {values('a', 'i,commune,district,province', [(i, *e) for i, e in enumerate(_EXPECTED)])} SELECT c_custkey,commune,district,province FROM customer JOIN a ON a.i=c_custkey%{len(_ADDRESSES)}")
def address_terms(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(a) for a in _ADDRESSES]), (F.col("c_custkey") % len(_ADDRESSES)).cast("int"))
    return rows(spark, sf_dir, "customer").select("c_custkey", address.parts(address.split_terms(raw)).alias("x")).select("c_custkey", "x.*")


@query("WITH o AS (SELECT c_custkey,'c'||c_custkey AS commune FROM customer WHERE c_custkey%3<>0), n AS (SELECT c_custkey,CASE WHEN c_custkey%4=1 THEN '' ELSE 'p'||c_custkey END AS province FROM customer WHERE c_custkey%5<>0) SELECT coalesce(o.c_custkey,n.c_custkey) AS c_custkey,coalesce(o.commune,'echo') AS old_commune,n.province AS new_province,coalesce(n.province,'')<>'' AS found FROM o FULL JOIN n ON o.c_custkey=n.c_custkey")
def address_old_new(spark, sf_dir):
    c, k = rows(spark, sf_dir, "customer").select("c_custkey"), F.col("c_custkey")
    none = F.lit(None).cast("string")
    ask = c.select("c_custkey", F.lit("echo").alias("echo_commune"), none.alias("echo_district"), none.alias("echo_province"), none.alias("echo_formatted"))
    old = c.where(k % 3 != 0).select("c_custkey", F.concat(F.lit("c"), k).alias("commune"), none.alias("district"), none.alias("province"), none.alias("formatted"))
    new = c.where(k % 5 != 0).select("c_custkey", none.alias("commune"), none.alias("district"), F.when(k % 4 == 1, "").otherwise(F.concat(F.lit("p"), k)).alias("province"), none.alias("formatted"))
    return address.old_and_new(ask, old, new, "c_custkey").select("c_custkey", "old_commune", "new_province", "found")


@query(f"WITH {NAMES_SQL} SELECT c_custkey,CASE WHEN lower(raw) LIKE 'phường%' OR lower(raw) LIKE 'thị trấn%' THEN 'phuong' WHEN lower(raw) LIKE 'đặc khu%' THEN 'dac_khu' ELSE 'xa' END AS commune_type FROM name")
def infer_commune_type(spark, sf_dir):
    return names(spark, sf_dir).select("c_custkey", text.infer_commune_type(F.col("raw")).alias("commune_type"))


@query(f"WITH {NAMES_SQL},f AS (SELECT c_custkey,province,lower({fold_sql('raw')}) AS r FROM name) SELECT c_custkey,regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(r,'^thanh pho ',''),'^tinh ',''),'^thu do ',''),'[^a-z0-9]+','-','g'),'^-|-$','','g') AS slug,province||'-'||regexp_replace(regexp_replace(r,'[^a-z0-9]+','-','g'),'^-|-$','','g') AS code,trim(regexp_replace(r,'[^a-z0-9]+',' ','g')) AS key FROM f")
def slug_code(spark, sf_dir):
    raw = F.col("raw")
    return names(spark, sf_dir).select("c_custkey", text.slugify(raw).alias("slug"), text.to_code(F.col("province"), raw).alias("code"), text.normalize_key(raw).alias("key"))


# Numbers as written, their ETL reading and their display reading.
NUMBERS = [("1.234.567", 1234567.0, 1234567.0), ("12,5", 12.5, 12.5), ("1,2,345", 12345.0, None), ("9.5", 9.5, 9.5), ("27°C - 28°C.", None, None), ("-", None, None), ("1.234,56", 1234.56, 1234.56), ("0,123", 123.0, 123.0), ("9.500", 9500.0, 9500.0), ("1.23.456", None, None), ("10,71% trở lên", 10.71, 10.71), ("", None, None)]
_NUMBER_SQL = values("number", "i,raw,etl,ui", [(i, *n) for i, n in enumerate(NUMBERS)])


def _numbers(spark, sf_dir, every_group: bool) -> DataFrame:
    raw = F.get(F.array(*[F.lit(n[0]) for n in NUMBERS]), (F.col("o_orderkey") % len(NUMBERS)).cast("int"))
    return rows(spark, sf_dir, "orders").select("o_orderkey", numeric.parse_numeric(raw, every_group).alias("parsed"))


@query(f"WITH {_NUMBER_SQL} SELECT o_orderkey,CAST(etl AS DOUBLE) AS parsed FROM orders JOIN number ON i=o_orderkey%{len(NUMBERS)}")
def parse_numeric_etl(spark, sf_dir):
    return _numbers(spark, sf_dir, False)


@query(f"WITH {_NUMBER_SQL} SELECT o_orderkey,CAST(ui AS DOUBLE) AS parsed FROM orders JOIN number ON i=o_orderkey%{len(NUMBERS)}")
def parse_numeric_ui(spark, sf_dir):
    return _numbers(spark, sf_dir, True)


@query("SELECT p_partkey,CASE WHEN p_size%10<>0 THEN round(CAST(p_partkey AS DOUBLE)/(p_size%10),2) END AS density FROM part")
def density(spark, sf_dir):
    return rows(spark, sf_dir, "part").select("p_partkey", numeric.density(F.col("p_partkey").cast("double"), F.col("p_size") % 10).alias("density"))


@query("SELECT o_orderkey,replace(replace(replace(format('{:,}',o_orderkey*1237),',','#'),'.',','),'#','.') AS shown FROM orders")
def format_vi_number(spark, sf_dir):
    return rows(spark, sf_dir, "orders").select("o_orderkey", numeric.format_vi(F.col("o_orderkey") * 1237, 0).alias("shown"))


@query("SELECT page_id,md5(trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(html,'<!--[^\\n\\r]*?-->',' ','g'),'<[bB][rR]\\s*/?>',chr(10),'g'),'<[^>]+>',' ','g'),'&nbsp;',' '),'[\\s\\x{00A0}\\x{FEFF}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+',' ','g'))) AS text_md5 FROM pages")
def html_clean(spark, sf_dir):
    return rows(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_html(F.col("html"))).alias("text_md5"))


@query("SELECT page_id,CASE WHEN regexp_matches(html,'<title>([^<]*)</title>') THEN trim(regexp_extract(html,'<title>([^<]*)</title>',1)) END AS title,CASE WHEN regexp_matches(html,'<meta[^>]+charset=\"([^\"]*)\"') THEN regexp_extract(html,'<meta[^>]+charset=\"([^\"]*)\"',1) END AS charset FROM pages")
def html_meta_title(spark, sf_dir):
    html = F.col("html")
    return rows(spark, sf_dir, "pages").select("page_id", text.first_match(html, "<title>([^<]*)</title>").alias("title"), text.first_match(html, '<meta[^>]+charset="([^"]*)"').alias("charset"))


@query("SELECT event_id,CAST(regexp_extract(props,'\"k\": *([0-9]+)',1) AS BIGINT) AS k FROM events WHERE regexp_matches(props,'\"k\": *[0-9]+')")
def embedded_json_scan(spark, sf_dir):
    found = F.regexp_extract_all("props", F.lit(r"\{[^{}]*\}"), F.lit(0))
    objects = rows(spark, sf_dir, "events").select("event_id", F.explode(found).alias("o"))
    return objects.select("event_id", F.try_variant_get(F.try_parse_json("o"), "$.k", "long").alias("k")).where("k is not null")


@query("SELECT doc_id,n_chars,lang FROM (SELECT *,row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn=1")
def dedup_keep_first(spark, sf_dir):
    docs = rows(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", F.sha2("text", 256).alias("h"))
    return profile.keep_first(docs, ["h"], ["doc_id"]).drop("h")


@query("SELECT p_type,count(*) AS n,count(*) FILTER (WHERE p_size>25) AS n_large FROM part WHERE contains(lower(p_name||' '||p_brand),'1') GROUP BY p_type")
def unit_search(spark, sf_dir):
    found = profile.search_units(rows(spark, sf_dir, "part"), ["p_name", "p_brand"], " 1 ", "p_type")
    return found.groupBy("p_type").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 25).alias("n_large"))


@query(f"WITH {PROVINCE_SQL} SELECT code AS province_code,round((e-w)*(n-s),6) AS area,round((w+e)/2,6) AS lon,round((s+n)/2,6) AS lat FROM province")
def ring_area_label(spark, sf_dir):
    p = seeds.provinces(spark).withColumn("r", geo.ring(*[F.col(c) for c in ("west", "south", "east", "north")]))
    at = geo.label_point(F.col("r"))
    return p.select("province_code", F.round(geo.ring_area(F.col("r")), 6).alias("area"), F.round(at["lon"], 6).alias("lon"), F.round(at["lat"], 6).alias("lat"))


@query("SELECT r_name,min(n_nationkey) AS first_nation,count(*) AS parts,string_agg(n_name,',' ORDER BY n_nationkey) AS members FROM nation JOIN region ON n_regionkey=r_regionkey GROUP BY r_name")
def dissolve_membership(spark, sf_dir):
    nations = rows(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), F.col("n_nationkey").alias("ord"), "n_name")
    merged = profile.dissolve(nations, rows(spark, sf_dir, "region").select("r_regionkey", "r_name"), "r_regionkey", "r_name", "n_name")
    return merged.select("r_name", F.col("ord").alias("first_nation"), "parts", F.array_join("multipolygon", ",").alias("members"))


@query("SELECT conv_id,md5(string_agg(text,chr(10) ORDER BY turn,text)) AS knowledge_md5 FROM conversations GROUP BY conv_id")
def knowledge_concat(spark, sf_dir):
    return profile.knowledge(rows(spark, sf_dir, "conversations"), "conv_id", ["turn"], "text").select("conv_id", F.md5("knowledge").alias("knowledge_md5"))


@query("SELECT source,string_agg(doc_id,',' ORDER BY rn) AS top FROM (SELECT source,doc_id,row_number() OVER (PARTITION BY source ORDER BY n_chars DESC,doc_id) AS rn FROM documents) WHERE rn<=5 GROUP BY source")
def topk_context(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    top = rows(spark, sf_dir, "documents").select("source", "doc_id", F.row_number().over(w).alias("rn")).where("rn <= 5")
    return top.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("top"))


@query("SELECT user_id,event_id,event_type FROM (SELECT *,row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,event_id DESC) AS rn FROM events) WHERE rn=1")
def latest_request_wins(spark, sf_dir):
    e = rows(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("x"))
    return e.select("user_id", "x.*")


@query("SELECT n_name,count(s_suppkey) AS n_suppliers,coalesce(string_agg(s_name,',' ORDER BY s_name),'') AS names FROM nation LEFT JOIN supplier ON s_nationkey=n_nationkey GROUP BY n_name")
def collect_group_sort(spark, sf_dir):
    n, s = rows(spark, sf_dir, "nation"), rows(spark, sf_dir, "supplier")
    own = n.join(s, n["n_nationkey"] == s["s_nationkey"], "left").groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"), F.array_join(F.array_sort(F.collect_list("s_name")), ",").alias("names"))
    return own


@query("SELECT c_custkey,CASE WHEN c_custkey%3=0 THEN 'a' WHEN c_custkey%5=0 THEN 'b' ELSE c_mktsegment END AS picked FROM customer")
def fallback_coalesce(spark, sf_dir):
    k = F.col("c_custkey")
    return rows(spark, sf_dir, "customer").select("c_custkey", text.first_non_blank(F.when(k % 3 == 0, "a").otherwise(" "), F.when(k % 5 == 0, "b"), F.col("c_mktsegment")).alias("picked"))


@query(f"SELECT confidence,conflict,count(*) AS n FROM ({ORACLE_SQL['resolve_confidence']}) GROUP BY confidence,conflict")
def provider_conflict(spark, sf_dir):
    return resolve_confidence(spark, sf_dir).groupBy("confidence", "conflict").agg(F.count("*").alias("n"))


_DOCUMENTS = [
    '\ufeff{"administrative_code":{"value":1},"location":{"latitude":{"value":"21,02"}},"population":{"total":{"value":8435700}},"infrastructure":{"seaport":{"value":["a","b"]},"airport":{"value":["c"]}}}',
    "{bad",
    '{"administrative_code":{"value":"48"},"infrastructure":{"seaport":{"value":"none"}}}',
    '{"population":{"total":{"value":"n/a"}},"location":{"latitude":{"value":10.5}}}',
]
_PROFILES = [(True, "1", 21.02, 8435700.0, 3), (False, None, None, None, 0), (True, "48", None, None, 0), (True, None, 10.5, None, 0)]


@query(f"WITH {values('a', 'i,has_profile,administrative_code,latitude,population,n_infrastructure', [(i, *e) for i, e in enumerate(_PROFILES)])} SELECT c_custkey,has_profile,administrative_code,latitude,population,n_infrastructure FROM customer JOIN a ON a.i=c_custkey%{len(_DOCUMENTS)}")
def json_profile_fields(spark, sf_dir):
    raw = F.get(F.array(*[F.lit(d) for d in _DOCUMENTS]), (F.col("c_custkey") % len(_DOCUMENTS)).cast("int"))
    name = F.col("c_custkey").cast("string")
    docs = rows(spark, sf_dir, "customer").select(name.alias("file_name"), name.alias("name_key"), text.strict_json(text.strip_bom(raw)).alias("doc"))
    return profile.profile(docs).select(F.col("file_name").cast("long").alias("c_custkey"), "has_profile", "administrative_code", "latitude", "population", F.size("infrastructure").alias("n_infrastructure"))
