"""Texts for language models: news, knowledge and prompts, and the enrichment of documents by their answers.

A model is a table of recorded answers; what it is asked and what becomes of its answers is computed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import name_of_file, strict_json, strip_bom

# The three texts that an answer must have.
ANSWER = ["tinh_hinh_rung", "tinh_hinh_bien", "o_nhiem_tong_hop"]


def news_context(hits: Column, most: int = 5) -> Column:
    """Title and description of the first hits (an array), a blank line between."""
    return F.array_join(F.transform(F.slice(hits, 1, most), lambda h: F.concat(F.lit("Tiêu đề: "), h["title"], F.lit(" \nNội dung: "), h["description"])), "\n\n")


def knowledge_part(kind: Column, file_name: Column, text: Column) -> Column:
    """A file's text under its heading."""
    return F.concat(F.lit("\n\n--- TÀI LIỆU ("), kind, F.lit("): "), file_name, F.lit(" ---\n"), text)


def prompt(rules: str, knowledge: Column, message: Column) -> Column:
    """The messages that a model is sent: rules with all knowledge, and the user's last message alone."""
    one = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.array(one("system", F.concat(F.lit(rules), knowledge)), one("user", message))


def read_answer(answer: Column) -> Column:
    """The texts of a model's answer; null unless it is JSON with all three."""
    doc = F.from_json(answer, ", ".join(f"{c} string" for c in ANSWER))
    return F.when(F.coalesce(*[F.when(doc[c].isNull(), F.lit(False)) for c in ANSWER], doc.isNotNull()), doc)


def enrich(documents: DataFrame, answers: DataFrame, stamp: Column | None = None, first: int | None = None) -> DataFrame:
    """documents (file_name, doc: JSON text) with their model's answer merged in as environmental_data.

    Gives file_name, province_name, step (its place by file name), total, doc, error. A document that is no JSON, or whose
    answer is missing or not sound, stays as it was and says why: one failure stops no other. first: only that many
    documents, by file name. Documents are the catalogue's files (34), numbered in one window."""
    order = Window.orderBy("file_name")
    rows = documents.withColumn("step", F.row_number().over(order)).withColumn("total", F.count("*").over(Window.partitionBy()))
    if first is not None:
        rows = rows.where(F.col("step") <= first)
    own = answers.select(F.col("file_name").alias("_file"), F.col("answer").alias("_answer"))
    rows = rows.join(own, F.col("file_name") == F.col("_file"), "left").withColumn("_read", read_answer(F.col("_answer")))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'") if stamp is None else stamp
    old = F.from_json(F.to_json(strict_json(strip_bom(F.col("doc")))), "map<string,variant>")
    data = F.struct(stamp.alias("last_updated"), *[F.col("_read")[c].alias(c) for c in ANSWER])
    extra = F.from_json(F.to_json(F.struct(data.alias("environmental_data"))), "map<string,variant>")
    error = F.when(old.isNull(), "document is not JSON").when(F.col("_answer").isNull(), "no answer").when(F.col("_read").isNull(), "answer is not sound")
    merged = F.to_json(F.map_concat(F.map_filter(old, lambda k, _: k != "environmental_data"), extra))
    return rows.select("file_name", name_of_file(F.col("file_name")).alias("province_name"), "step", "total", F.when(error.isNull(), merged).otherwise(F.col("doc")).alias("doc"), error.alias("error"))
