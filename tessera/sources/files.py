"""Files in and out: GeoJSON collections, map elements, JSON documents, knowledge folders, snapshots and responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import geo
from tessera.functions.text import strict_json
from tessera.operators.knowledge import knowledge_part
from tessera.sources import seeds

_POINT = "struct<lon:double,lat:double>"
_MULTI = f"array<array<array<{_POINT}>>>"


def points_of(coordinates: Column) -> Column:
    """Rings of [lon, lat] pairs as rings of points."""
    return F.transform(coordinates, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))))


def geometry_of(g: Column) -> Column:
    """A GeoJSON geometry (VARIANT) as a multipolygon; null for any other type."""
    kind = F.try_variant_get(g, "$.type", "string")
    one = points_of(F.try_variant_get(g, "$.coordinates", "array<array<array<double>>>"))
    many = F.transform(F.try_variant_get(g, "$.coordinates", "array<array<array<array<double>>>>"), points_of)
    return F.when(kind == "Polygon", F.array(one)).when(kind == "MultiPolygon", many).cast(_MULTI)


def features_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """A row for each feature of GeoJSON texts: collection (its type), ord, properties (VARIANT), geometry."""
    doc = strict_json(F.col(text))
    rows = texts.select(F.try_variant_get(doc, "$.type", "string").alias("collection"), F.posexplode(F.try_variant_get(doc, "$.features", "array<variant>")).alias("ord", "f"))
    return rows.select("collection", "ord", F.try_variant_get("f", "$.properties", "variant").alias("properties"), geometry_of(F.try_variant_get("f", "$.geometry", "variant")).alias("geometry"))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file, which is read as one text: collections are of a territory's size."""
    return features_of(spark.read.text(path, wholetext=True))


def province_features(spark: SparkSession, path: str) -> DataFrame:
    """The checked features of the 34 provinces: ord, province_id, province_code, province_name, province_kind, geometry."""
    get = lambda f: F.try_variant_get("properties", f"$.{f}", "string").alias(f)
    return seeds.checked_features(read_features(spark, path)).select("ord", *[get(f) for f in ("province_id", "province_code", "province_name", "province_kind")], "geometry")


def commune_features(spark: SparkSession) -> DataFrame:
    """The checked features of the communes, from their boxes."""
    rows = seeds.checked_communes(spark).select(F.lit("FeatureCollection").alias("collection"), "ord", "commune_code", "commune_name", "commune_type", "province_code", F.array(F.array(geo.ring(*[F.col(c) for c in ("west", "south", "east", "north")]))).alias("geometry"))
    return seeds.checked_features(rows, None).drop("collection")


def feature_json(properties: list[str], geometry: str = "geometry") -> Column:
    """A row as a GeoJSON feature; one polygon as Polygon, more as MultiPolygon."""
    pairs = F.transform(F.col(geometry), lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))
    shape = F.when(F.size(geometry) == 1, F.to_json(F.struct(F.lit("Polygon").alias("type"), F.get(pairs, F.lit(0)).alias("coordinates")))).otherwise(F.to_json(F.struct(F.lit("MultiPolygon").alias("type"), pairs.alias("coordinates"))))
    return F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), shape, F.lit("}"))


def collection_json(features: DataFrame, properties: list[str], order: str, geometry: str = "geometry") -> DataFrame:
    """One row: the features of a territory as a GeoJSON collection."""
    rows = features.select(F.col(order).alias("o"), feature_json(properties, geometry).alias("f"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "f"))), lambda x: x["f"]), ",")
    return rows.agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), joined, F.lit("]}")).alias("value"))


def write_text(rows: DataFrame, path: str) -> None:
    """Rows of one text column as text files."""
    rows.write.mode("overwrite").text(path)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents (file_name, doc) as JSON lines, replacing what was there; no file is rewritten in place."""
    documents.select("file_name", "doc").write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str, *by: str) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a saved map query: ord, name_vi, name, lat, lon."""
    doc = strict_json(F.col("value"))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.coalesce(F.try_variant_get(doc, "$.elements", "array<variant>"), F.array().cast("array<variant>"))).alias("ord", "e"))
    get = lambda p, kind="string": F.try_variant_get("e", p, kind)
    return rows.select("ord", get("$.tags['name:vi']").alias("name_vi"), get("$.tags.name").alias("name"), get("$.center.lat", "double").alias("lat"), get("$.center.lon", "double").alias("lon"))


def read_snapshots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The provinces of a snapshot file, in order; a malformed file fails the job."""
    whole = f"generated_at string, source struct<name:string,url:string,terms_url:string,note:string>, provinces array<{schema}>"
    rows = spark.read.schema(whole).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select("generated_at", F.posexplode("provinces").alias("ord", "snapshot"))


def snapshot_file(snapshots: DataFrame, order: Column, stamp: Column, source: Column) -> DataFrame:
    """One row: the snapshot file of a territory's provinces, in order."""
    return snapshots.agg(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("snapshot").alias("s")))), lambda x: x["s"]).alias("provinces")).select(F.to_json(F.struct(stamp.alias("generated_at"), source.alias("source"), "provinces")).alias("value"))


def read_knowledge(spark: SparkSession, folder: str, pdf_text=None) -> DataFrame:
    """file_name, part: the headed text of every .txt file of a folder and, if a Column function from a PDF's bytes to
    its text is given, of every .pdf file. A folder that is not there is made, and empty."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(path):
        system.mkdirs(path)
    name = F.col("_metadata.file_name")
    out = spark.read.option("wholetext", True).option("pathGlobFilter", "*.txt").text(folder).select(name.alias("file_name"), knowledge_part(F.lit("TXT"), name, F.col("value")).alias("part"))
    if pdf_text is not None:
        pdf = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
        out = out.unionByName(pdf.select(name.alias("file_name"), knowledge_part(F.lit("PDF"), name, pdf_text(F.col("content"))).alias("part")))
    return out


def knowledge_base(parts: DataFrame, size: int = 64 << 20) -> DataFrame:
    """One row: all parts by file name, as every prompt brings them. A base that a prompt could not hold (more than
    `size` characters) fails the job."""
    total = F.sum(F.length("part"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("file_name", "part"))), lambda x: x["part"]), "")
    return parts.agg(F.when(F.coalesce(total, F.lit(0)) <= size, joined).otherwise(F.raise_error(F.lit("the knowledge base is too large"))).alias("knowledge"))


def response(status: Column, body: Column) -> Column:
    """A response as its status and JSON body."""
    return F.struct(status.alias("status"), F.to_json(body).alias("body"))
