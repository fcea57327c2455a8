import collections
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import cluster, language
from tessera.llm.cluster import table
from tests.llm.test_operators import brute_components, library_ids, lowered

DATA = "/root/testdata/sf0.001"


def windows_of(spark):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    items = [cut(r.text) for r in table(spark, DATA, "benchmark").collect()]
    return cut, [tuple(w[i : i + min(10, len(w))]) for w in items if w for i in range(len(w) - min(10, len(w)) + 1)]


def leaks(cut, windows, text):
    w = cut(text)
    grams = {tuple(w[i : i + n]) for n in {len(x) for x in windows} for i in range(len(w) - n + 1)}
    return any(x in grams for x in windows)


def test_run_equals_brute_force(spark):
    docs = table(spark, DATA, "documents")
    pieces = corpus_pipeline.run(spark, DATA).collect()
    said = {r.doc_id: r for r in language.predict(docs, language.fit(docs)).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows = [(d, t) for d, t in rows if said[d].lang_pred != "und" and said[d].score >= language.LEAST]
    first = {d: c for d, _, c in brute_components(rows, 5, 4, 5)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    cut, windows = windows_of(spark)
    rows = [(d, t) for d, t in rows if not leaks(cut, windows, t)]
    assert 50 < len(rows) < len(first) < docs.count() + 1
    by_doc, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length))
        sequences[p.sequence_id].append((p.offset, p.length))
    assert set(by_doc) == {d for d, _ in rows}
    for d, text in rows:
        end = 0
        for start, length in sorted(by_doc[d]):
            assert start == end
            end += length
        assert end == len(library_ids(text)) + 1
    for own in sequences.values():
        assert sum(n for _, n in own) <= 1024 and len(own) <= 8


ODD = [(1, None), (2, ""), (2, " \t"), (3, "123 456"), (None, "Der die das und nicht ein Wort"), (None, "Der die das und nicht ein Wort"), (4, "the and of to in is it"), (4, "the and of to in is it"), (5, "long " * 40_000 + "end")]


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, at):
    name, stage = corpus_pipeline.STAGES[at]
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.when(F.col("doc_id") == 4, "en").when(F.col("doc_id").isNull(), "de"), "source": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("long"), "component_id": F.lit("clash"), "sig": F.lit("clash"), "keep_id": F.lit("clash"), "score": F.lit("clash"), "start": F.lit("clash")})
    for df in (odd, odd.limit(0), odd.drop("component_id", "sig", "keep_id", "score", "start")):
        out = stage(spark, df, DATA)
        got = out.collect()
        if name != "packing":
            assert out.columns == df.columns
        if df.columns == odd.columns and df.isEmpty():
            assert not got
            continue
        count = collections.Counter((r.doc_id, r.text) for r in got) if name != "packing" else None
        if name == "language_id":
            assert all(any(c.isalpha() for c in r.text or "") for r in got) and count[(4, ODD[6][1])] == 2
        elif name == "ngram_jaccard":
            assert count[(4, ODD[6][1])] == 1 and count[(None, ODD[4][1])] == 1 and sum(not (r.text or "").strip() for r in got) == 3 and len(got) == 7
        elif name == "decontamination":
            assert len(got) == len(ODD)
        else:
            assert sum(r.length for r in got) == sum(len(library_ids(t)) + 1 for _, t in ODD)


def test_the_shared_folder(spark, monkeypatch):
    folder = cluster.new_folder(spark, "probe")
    spark.range(3).write.parquet(folder)
    assert folder.startswith(cluster.shared_folder(spark))
    monkeypatch.setattr(cluster, "_made", [folder])
    cluster.sweep(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


def test_no_folder_of_its_own_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        cluster.shared_folder(Session())
