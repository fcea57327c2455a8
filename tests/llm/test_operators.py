import base64
import collections
import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_text, language, licenses, near_copies, neighbours, packing, queries, token_counts, tokens, warc
from tessera.llm.cluster import new_folder, table

DATA = "/root/testdata/sf0.001"
ODD = [(900001, None), (900002, ""), (900003, " \n "), (900004, "ab"), (900005, "ab"), (900005, "ab"), (900006, "é ü 漢 " * 3000), (None, "no id at all"), (900007, "<|endoftext|> under the MIT License")]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame(ODD, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(0).cast("long"), "component_id": F.lit("clash"), "n_words": F.lit(-1)})
    own = table(spark, DATA, "documents").withColumns({"component_id": F.lit("clash"), "n_words": F.lit(-1)})
    return own.unionByName(odd).repartition(5).cache()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {','.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=str) == sorted(want, key=str)


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def brute_components(rows, k, p, q):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and q * len(a & b) >= p * len(a | b):
                root[top(i)] = top(j)
    least = collections.defaultdict(list)
    for i in range(len(rows)):
        least[top(i)].append(rows[i][0])
    smallest = {t: min((x for x in v if x is not None), default=None) for t, v in least.items()}
    return sorted(((rows[i][0], len(sets[i]), smallest[top(i)] if sets[i] else rows[i][0]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize(("k", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_join_equals_brute_force(docs, k, p, q):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted((tuple(r) for r in near_copies.join(docs, k, p, q).collect()), key=str)
    assert got == brute_components(rows, k, p, q)


def test_join_of_near_copies_and_of_nothing(spark, docs):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: i % 50] + ["x" + str(i % 3 * (i // 50))] + base[i % 50 + 1 :])) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in near_copies.join(df, 3, 9, 10).collect()), key=str) == brute_components(rows, 3, 9, 10)
    assert near_copies.join(docs.limit(0)).count() == 0


def brute_links(rows, k, p, q):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    nodes = {s for s in sets if s}
    n = {a: sum(q * len(a & b) >= p * len(a | b) for b in nodes if b != a) for a in nodes}
    return sorted(((rows[i][0], n.get(s, 0)) for i, s in enumerate(sets)), key=str)


@pytest.mark.parametrize(("k", "p", "q"), [(3, 9, 10), (5, 4, 5)])
def test_every_link_is_counted(spark, docs, k, p, q):
    import random

    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for i in range(200):  # families over many hot columns, some with words of their own alone
        own = list(base)
        for _ in range(rng.randint(0, 2)):
            own[rng.choice([3, 40, 41, 77, 110])] = rng.choice(["x", "y", "z"])
        rows.append((10_000 + i, " ".join(own + [f"own{i}_{j}" for j in range(rng.choice([0, 0, 1, 4]))])))
    rows += [(20_000 + i, " ".join([f"v{j}" for j in range(60)] + [f"only{i}_{j}" for j in range(i % 9)])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_copies.link_counts(df, k, p, q).collect()
    assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == brute_links(rows, k, p, q)
    assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(rows, k, p, q)


def test_one_of_each_group_stays(docs):
    stay = near_copies.first_of_each(docs)
    assert stay.columns == docs.columns
    ids = [r.doc_id for r in stay.select("doc_id").collect()]
    assert 900005 not in ids and ids.count(900004) == 1 and 900001 in ids and None in ids


def test_rows_that_no_id_names_link_and_go_by_their_text(spark):
    base = [f"w{i}" for i in range(110)]
    a, c = " ".join(base), " ".join(base[:100] + ["x"] * 3 + base[103:106] + ["y"] * 4)
    b = " ".join(base[:103] + base[103:106] + ["y"] * 4)
    other = "something else entirely that stands alone here"
    for ids in ((1, None, 3), (5, 5, None)):
        rows = [(ids[0], a), (ids[1], b), (ids[2], c), (ids[1], other), (ids[1], other), (8, ""), (8, None), (None, " ")]
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit("clash"))
        if None in ids[1:2]:
            got = near_copies.link_counts(df, 5, 4, 5).collect()
            assert sorted((tuple(r)[:3] for r in got), key=str) == brute_components(rows, 5, 4, 5), ids
            assert sorted(((r.doc_id, r.n_links) for r in got), key=str) == brute_links(rows, 5, 4, 5), ids
        stay = [(r.doc_id, r.text) for r in near_copies.first_of_each(df, 5, 4, 5).collect()]
        family = [x for x in stay if x[1] in (a, b, c)]
        assert len(family) == 1 and family[0][0] == min((i for i in ids if i is not None), default=None), ids
        assert stay.count((ids[1], other)) == 1 and sum(not (t or "").strip() for _, t in stay) == 3, ids


def library_ids(text):
    from tokenizers import Tokenizer

    library_ids.model = getattr(library_ids, "model", None) or Tokenizer.from_file(tokens.tokenizer_path())
    return library_ids.model.encode(text or "", add_special_tokens=False).ids


def test_packing_is_whole_and_tight(docs):
    pieces = packing.pack(docs).collect()
    sequences = collections.defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for own in sequences.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end and length > 0
            end += length
        assert end <= 1024 and (end & (end - 1)) == 0
    want = {}
    for r in docs.where("doc_id is not null").collect():
        want[r.doc_id] = [*library_ids(r.text), 0]
    by_doc = collections.defaultdict(set)
    for p in pieces:
        by_doc[p.doc_id].add((p.start, p.length, p.ids_crc32, p.doc_tokens))
    for doc, ids in want.items():
        covered = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert total == len(ids)
            assert crc == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[start : start + length]))
            covered = max(covered, start + length)
        assert covered == len(ids)


def test_packing_of_prompts_under_binding_limits(spark, docs):
    rows = spark.createDataFrame([(i, "Question, number %d: " % i + "why " * (i % 40), "Because. " * (i * 7 % 30)) for i in range(400)] + [(400, None, None), (401, "only asked", ""), (402, "p " * 900, "t " * 700)], "doc_id long, prompt string, text string")
    limits = packing.Limits(tokens=256, segments=6, loss=90)
    pieces = packing.pack(rows, limits=limits, with_ids=True, prompt="prompt").collect()
    total, by_doc = collections.defaultdict(lambda: [0, 0, 0]), collections.defaultdict(list)
    for p in pieces:
        assert p.ids and len(p.ids) == p.length
        by_doc[p.doc_id].append(p)
        for i, v in enumerate((p.length, 1, p.loss_tokens)):
            total[p.sequence_id][i] += v
    assert all(t <= 256 and n <= 6 and x <= 90 for t, n, x in total.values())
    assert any(n == 6 for _, n, _ in total.values()) and any(x == 90 for _, _, x in total.values()) and any(t == 256 for t, _, _ in total.values())
    for r in rows.collect():
        own = sorted(by_doc[r.doc_id], key=lambda p: p.start)
        head, body = library_ids(r.prompt), library_ids(r.text)
        assert [i for p in own for i in p.ids] == [*head, *body, 0] and sum(p.loss_tokens for p in own) == len(body)
    short = spark.range(5000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text"))
    segments = packing.pack(short).groupBy("sequence_id").count()
    assert segments.agg(F.max("count")).first()[0] == packing.MAX_SEGMENTS


def test_packing_limits(docs):
    limits = packing.Limits(tokens=256, segments=3, loss=200)
    found = packing.pack(docs, limits=limits).groupBy("sequence_id").agg(F.sum("length").alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    assert found.where("t > 256 or s > 3 or l > 200").count() == 0


def test_counts_and_their_cache(spark, docs):
    cache = new_folder(spark, "cache")
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(library_ids(r.text))) for r in docs.collect()), key=str)
    for _ in range(2):
        got = token_counts.count_tokens(docs, cache).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()


def test_neighbours_recall_and_edge_cases(spark):
    rows = table(spark, DATA, "embeddings").select("vec_id", "embedding")
    odd = spark.createDataFrame([(90020, None), (90040, [0.0] * 64), (90060, [float("nan")] * 64), (90080, [None] * 64), (90001, [1.0])], "vec_id long, embedding array<float>")
    copies = rows.where("vec_id = 20").select(F.explode(F.sequence(F.lit(50000).cast("long"), F.lit(50060).cast("long"))).alias("vec_id"), "embedding")
    every = rows.unionByName(odd).unionByName(copies).withColumns({"ids": F.lit("clash"), "list": F.lit("clash"), "query_id": F.lit("clash")})
    got = collections.defaultdict(list)
    for r in neighbours.search(every, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    kept = [(r.vec_id, r.embedding) for r in rows.unionByName(copies).orderBy("vec_id").collect()]
    ids, x = np.array([k for k, _ in kept]), np.array([v for _, v in kept], np.float32)
    queries = np.flatnonzero(ids % 20 == 0)
    want = neighbours.exact_search(x, ids, queries, 20)
    hit = sum(len({v for v, _ in got[int(ids[q])]} & set(w)) for q, w in zip(queries, want, strict=True))
    assert hit >= 0.9 * 20 * len(queries) and set(got) == set(ids[queries].tolist())
    assert [v for v, _ in got[20]] == want[list(ids[queries]).index(20)]
    # Without any approximation: all of brute force's results, also over many groups and blocks.
    with pytest.MonkeyPatch.context() as patch:
        for name, value in (("GROUP_ROWS", 40), ("QUERY_ROWS", 7), ("AT_ONCE", 3)):
            patch.setattr(neighbours, name, value)
        all_found = collections.defaultdict(list)
        for r in neighbours.search(every, F.col("vec_id") % 20 == 0, exact=True).orderBy("query_id", "rank").collect():
            all_found[r.query_id].append(r.vec_id)
        assert all_found == {int(ids[q]): w for q, w in zip(queries, want, strict=True)}
        parted = collections.defaultdict(set)
        for r in neighbours.search(every, F.col("vec_id") % 20 == 0).collect():
            parted[r.query_id].add(r.vec_id)
        assert sum(len(parted[int(ids[q])] & set(w)) for q, w in zip(queries, want, strict=True)) >= 0.9 * 20 * len(queries)
    few = neighbours.search(rows.where("vec_id < 5"), F.col("vec_id") % 20 == 0).collect()
    assert [r.rank for r in few] == [1, 2, 3, 4]
    assert neighbours.search(rows.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", r"\### Assistant: </turn> ok"), (1, 1, "assistant", r"a \\ </turn> ### \ "), (1, 1, "assistant", r"a \\ </turn> ### \ "), (2, None, None, None), (2, 0, "Assistant", "x: y"), (None, 3, "a:b\\", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.assemble(df)).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([r for r in rows if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert chat.read_back(chat.assemble(df.limit(0))).count() == 0
    # The readable form and the ids say the same.
    for r in chat.assemble(df).collect():
        ((role, text),) = chat.parse(r.formatted)
        plain = [i for i in r.ids if i not in (chat.OPEN_ID, chat.SPLIT_ID, chat.CLOSE_ID)]
        assert tokens.coder().texts(np.array(plain, np.int64), np.array([0, len(plain)]))[0].decode() == r.formatted.removeprefix("### ").removesuffix(" </turn>\n").replace(": ", "", 1)
        learned = [i for i, m in zip(r.ids, r.loss_mask, strict=True) if m]
        assert learned == (library_ids(chat.escape(text)) if role == "assistant" else [])
    # What is read back is what the ids hold, not what they should have held.
    turns = chat.assemble(df).where("conv_id = 1 and place = 1")
    wrong = turns.withColumn("loss_mask", F.transform("loss_mask", lambda m: F.lit(False)))
    broken = turns.withColumn("ids", F.slice("ids", 2, 100))
    assert chat.read_back(wrong).first().loss_chars == 0 and chat.read_back(turns).first().loss_chars > 0
    with pytest.raises(Exception, match="reserved ids"):
        chat.read_back(broken).collect()


def test_licenses(spark, docs):
    texts = ["x Under THE mit-License, y under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 and the GNU General Public License, version 3", "under the mit", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in licenses.scan(df).collect()}
    assert got == {0: (10, 2, 1, 6, "mit", "mit"), 1: (8, 1, 3, 3, "apache-2", "apache-2"), 2: (13, 1, 0, 0, "cc-by-nc", "cc-by-nc,gpl-3"), 3: (3, 0, None, None, "", ""), 4: (0, 0, None, None, "", "")}
    assert all(0 <= r.score <= 1 for r in licenses.scan(docs).collect())
    empty = licenses.scan(docs.limit(0))
    assert empty.count() == 0 and empty.columns == licenses.scan(docs).columns


def brute_licence(text):
    """Labels and score of one text, word by word, from the definition."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    notices = [n.split() for _, n, _ in licenses.TEMPLATES]
    df = collections.Counter(x for n in notices for x in set(n))
    labels, score = {label for p, label in licenses.BASE.items() if any(w[i : i + len(p.split())] == p.split() for i in range(len(w)))}, 0.0
    for notice, (label, _, needed) in zip(notices, licenses.TEMPLATES, strict=True):
        most = max(licenses.RARE * len(notices), min(df[x] for x in notice))
        weight = {j: np.log(1 + len(notices) / df[x]) for j, x in enumerate(notice) if df[x] <= most}
        votes = collections.defaultdict(set)
        for i, x in enumerate(w):
            for j in weight:
                if notice[j] == x:
                    votes[i - j].add(j)
        share = lambda js: sum(weight[j] for j in js) / sum(weight.values())  # noqa: E731, B023
        for begin in votes:
            near = set().union(*(votes[b] for b in votes if begin <= b <= begin + licenses.SLACK))
            score = max(score, share(votes[begin]), share(near) if share(near) >= licenses.LEAST else 0)
            if share(near) >= licenses.LEAST:
                placed = []
                for p in needed:
                    p = p.split()
                    own = next(j for j in range(len(notice)) if notice[j : j + len(p)] == p)
                    placed.append(any(w[i : i + len(p)] == p and -licenses.SLACK <= i - begin - own <= 2 * licenses.SLACK for i in range(len(w))))
                if all(placed):
                    labels.add(label)
    return ",".join(sorted(labels)), min(1.0, score)


def test_licence_labels_come_from_alignment(spark, docs):
    import random

    rng, rows = random.Random(3), []
    for _, notice, _ in licenses.TEMPLATES:
        words = notice.split()
        rows.append(notice)
        rows.append("Some text first. " + " ".join(words[:3] + ["really"] + words[3:]).upper() + " and after")  # a word put in
        rows.append(" ".join(words[: len(words) // 2]))
        shuffled = list(words)
        rng.shuffle(shuffled)
        rows.append(" ".join(shuffled))
        rows.append(" ".join(w for w in words if rng.random() > 0.2))
        rows.append(f"{notice} {' '.join(words[1:])} license license in in the mit")
    rows += [" ".join(rng.choice(licenses.TEMPLATES)[1] for _ in range(6)), "a b c " * 4000 + licenses.TEMPLATES[13][1]]
    rows += [r.text for r in docs.select("text").distinct().limit(60).collect() if len(r.text or "") < 2000]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.scan(df).collect()}
    for i, text in enumerate(rows):
        labels, score = brute_licence(text)
        assert got[i][0] == labels and abs(got[i][1] - score) < 1e-9, text
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in got[6 * i][0].split(",") and got[6 * i][1] == pytest.approx(1.0)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/ b%20c", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 9000), (5, "u", "é" * 9000), (None, "n", "<p>x</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit("clash"))
    manifest = warc.write(df)
    for size in (64, 1 << 22):
        got = warc.read(manifest, range_bytes=size).collect()
        assert len(got) == len(rows)
        by = collections.defaultdict(list)
        for r in got:
            by[r.payload_digest].append(r)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(next((x[2] or "") for x in rows if x[0] == r.page_id).encode()).digest()).decode()
        for own in by.values():
            response = [r for r in own if r.record_type == "response"]
            assert len(response) == 1 and all(r.refers_to == response[0].page_id for r in own if r.record_type == "revisit")
            assert response[0].page_id == max(r.page_id for r in own if r.page_id is not None)
    assert {r.url for r in got} == {r[1] for r in rows}
    assert warc.read(warc.write(df.limit(0))).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [(None, ""), ("", ""), ("plain  text", "plain text"), ("<nav>m</nav><article><h1>T</h1><p><b>One,<br>two<p>A&amp;B&nbsp;c</article><footer>f</footer>", "T One, two A&B c"), ("<div class='sidebar'>s</div><div><p>Body, text.</p><div class='comments'><p>no</p></div></div><form>f</form>", "Body, text."), ("<p>a<script>var t='</p>'</script>b</p>", "ab")],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


def test_deep_and_unclosed_pages():
    deep = "<p>" + "<b><i>" * 5000 + "Deep, text." + "</i></b>" * 5000 + "</p>"
    assert html_text.main_text(deep) == "Deep, text."
    assert html_text.main_text("<div>" * 5000 + "<p>Deep, text.</p>") == "Deep, text."
    assert html_text.main_text("<SCRIPT>var s = '</scripts>'</SCRIPT ><p>\u0130 one, two.</p><script>open") == "\u0130 one, two."


def test_sample_is_bounded_for_repeated_rows(spark):
    rows = spark.range(4000).select(F.lit(3).cast("long").alias("doc_id"), F.lit("one and the same words").alias("text"), F.lit("a").alias("lang"))
    other = spark.createDataFrame([(4, "zwei andere Dinge", "b"), (None, "und ohne Nummer", "b")], "doc_id long, text string, lang string")
    net = language.fit(rows.unionByName(other))
    assert net.languages == ["a", "b"]
    assert language.predict(rows, net).groupBy("lang_pred").count().collect()[0]["count"] == 4000


def test_language(docs):
    net = language.fit(docs)
    got = language.predict(docs, net).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and truth.get(r.doc_id)]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.9 * len(held)
    assert {r.lang_pred for r in got if r.doc_id in (900001, 900002, 900003)} == {"und"}
    assert all(0 <= r.score <= 1 for r in got)
    assert language.fit(docs.limit(0)) is None
    assert language.keep(docs, net).columns == docs.columns


def test_decontamination_equals_brute_force(spark, docs):
    bench = table(spark, DATA, "benchmark").select("item_id", "text").unionByName(spark.createDataFrame([(7000, "ab"), (7001, None), (7002, "é ü 漢"), (7002, "")], "item_id long, text string"))
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))
    items = [(str(r.item_id), cut(r.text)) for r in bench.collect()]
    want = []
    for r in docs.collect():
        w, hit, found = cut(r.text), set(), set()
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, own in items:
            size = min(10, len(own))
            for s in range(len(own) - size + 1) if own else ():
                for i in at[own[s]]:
                    if w[i : i + size] == own[s : s + size]:
                        hit.update(range(i, i + size))
                        found.add(item)
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    got = [tuple(r)[:6] for r in decontaminate.report(docs, bench).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate.clean(docs, bench).count() == sum(not x[5] for x in want)
    assert decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0
    matches = []
    for r in docs.collect():
        w = cut(r.text)
        at = collections.defaultdict(list)
        for i, x in enumerate(w):
            at[x].append(i)
        for item, own in items:
            size = min(10, len(own))
            for s in range(len(own) - size + 1) if own else ():
                for i in at[own[s]]:
                    n = 0
                    while s + n < len(own) and i + n < len(w) and own[s + n] == w[i + n]:
                        n += 1
                    if n >= size:
                        matches.append((item, s, r.doc_id, i, n))
    found = [tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()]
    assert sorted(found, key=str) == sorted(matches, key=str) and any(m[4] > 10 for m in matches)
    with pytest.MonkeyPatch.context() as patch:  # a test set of several shards
        patch.setattr(decontaminate, "TEST_WORDS", 200)
        assert sorted((tuple(r)[:6] for r in decontaminate.report(docs, bench).collect()), key=str) == sorted(want, key=str)
        kept = decontaminate.clean(docs, bench)
        assert kept.columns == docs.columns and kept.count() == sum(not x[5] for x in want)
        assert sorted((tuple(r) for r in decontaminate.longest_matches(docs, bench).collect()), key=str) == sorted(matches, key=str)


def test_documents_without_labels_stay(spark, docs):
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    net = language.fit(bare)
    want = sorted((r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")), key=str)
    assert net is None and len(want) > 200
    assert sorted((r.doc_id for r in language.keep(bare, net).collect()), key=str) == want
    assert language.keep(bare, net, languages=["en"]).count() == 0


def test_the_network_decides_what_stays(spark, docs):
    net = language.fit(docs)
    scored = language.predict(docs, net).join(docs.where("doc_id < 900000").select("doc_id", "text"), "doc_id").collect()
    for least, languages in ((language.LEAST, None), (0.95, None), (0.0, ["de", "fr"]), (0.0, [])):
        want = sorted(r.doc_id for r in scored if r.lang_pred != "und" and r.score >= least and (languages is None or r.lang_pred in languages))
        got = language.keep(docs, net, least, languages).where("doc_id < 900000")
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == want
    assert len([r for r in scored if r.score >= 0.95]) < len([r for r in scored if r.score >= language.LEAST])
    mixed = spark.createDataFrame([(1, "0123 --- 456 !!!"), (2, "zq xj"), (3, None)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    assert language.keep(mixed, net, least=0.999).count() == 0 and language.keep(mixed, net, least=0.0).columns == mixed.columns
    assert language.keep(docs.limit(0), net).count() == 0 and language.predict(docs.limit(0), None).count() == 0
    assert {(r.lang_pred, r.score) for r in language.predict(docs, None).collect()} == {("und", 0.0)}


BODY = "<h1>Title</h1><p>" + "One, two and three words. " * 20 + "</p><p>" + "More, of the same. " * 20 + "</p>"


@pytest.mark.parametrize("wrapper", ["div class='content no-sidebar'", "div class='with-sidebar'", "div id='has-comments'", "section class='post-form'", "form action='/x'", "div role='form'", "div class='widget search'"])
@pytest.mark.parametrize("inner", ["article", "main", "div"])
def test_marked_wrappers_keep_the_article(wrapper, inner):
    tag = wrapper.split()[0]
    page = f"<div class='banner'>buy now</div><{wrapper}><{inner}>{BODY}</{inner}><div class='sidebar'><p>aside text</p></div></{tag}><p class='cookie'>cookies</p>"
    got = html_text.main_text(page)
    assert got.startswith("Title One, two") and got.endswith("of the same.") and not any(x in got for x in ("buy", "aside", "cookies"))


def test_marks_still_drop_comments_and_give_way_to_nothing_left():
    readers = "<div class='comments-area'><article><p>" + "I think, so. " * 90 + "</p></article></div>"
    assert "think" not in html_text.main_text(f"<div><div>{BODY}</div>{readers}</div>")
    assert "think" not in html_text.main_text(f"<div><article>{BODY}</article>{readers}</div>")
    assert html_text.main_text("<div class='comments'><p>Only, this.</p></div>") == "Only, this."
    assert html_text.main_text("<div class='promo'><p>Left, here.</p></div><div class='menu'><p>and there.</p></div>") in ("Left, here.", "Left, here. and there.")


@pytest.mark.parametrize("wrapper", ["div", "main"])
def test_sibling_parts_stay(wrapper):
    teaser = "<ul><li><a href='/'>linked list</a></li></ul><article><a href='/'>linked teaser</a></article><article class='comment'>said, this</article>"
    page = f"<div><div><p><a href='/'>top</a></p></div><{wrapper}><article>{BODY}</article><article><p>Second part.</p></article><section><p>{'Beside, it. ' * 200}</p></section>{teaser}</{wrapper}></div>"
    got = html_text.main_text(page)
    assert "Title One" in got and "Second part." in got and "Beside, it." in got and "said" not in got
    assert wrapper == "main" or "linked" not in got
    plain = f"<div><div>{BODY}</div><h3>Short</h3><ul><li>item</li></ul><blockquote>quote</blockquote><pre>code</pre><ul><li><a href='/'>linked</a></li></ul></div>"
    got = html_text.main_text(plain)
    assert all(x in got for x in ("of the same.", "Short", "item", "quote", "code")) and "linked" not in got


def thue_morse(one: str, other: str, n: int) -> tuple[str, str]:
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join(other if b else one for b in bits), "".join(one if b else other for b in bits)


def test_regular_strings_do_not_collide(spark):
    texts = [*thue_morse(".", "/", 2048), *thue_morse("a", "b", 4096), *thue_morse("é", "ü", 1024)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(df).collect()}
    assert got == {i: len(library_ids(t)) for i, t in enumerate(texts)}
    assert [r.component_id for r in near_copies.join(df, 3, 9, 10).orderBy("doc_id").collect()] == list(range(len(texts)))


def test_counts_come_from_the_cache(spark):
    cache = new_folder(spark, "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    token_counts.count_tokens(first, cache).collect()
    version = tokens.version()
    digest = F.unhex(F.sha2(F.lit("planted text"), 256))
    for n in (76, 77):  # a count that was appended twice counts once
        spark.range(1).select(digest.alias("digest"), F.lit(version).alias("version"), F.lit(n).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    spark.range(1).select(F.unhex(F.sha2(F.lit("four"), 256)).alias("digest"), F.lit("another version").alias("version"), F.lit(99).cast("long").alias("n_tokens")).write.mode("append").parquet(cache)
    again = spark.createDataFrame([(1, "planted text"), (1, "planted text"), (4, "four"), (5, "four"), (6, "one two")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(again, cache).collect())
    assert got == [(1, 77), (1, 77), (4, 1), (5, 1), (6, 2)]
    assert spark.read.parquet(cache).where(F.col("version") == version).count() == 5
    assert token_counts.count_tokens(first.limit(0), cache).count() == 0 and spark.read.parquet(cache).count() == 6


def test_an_advert_longer_than_the_article_goes():
    page = "<body><div class='ad'>Long advert text, much longer than the article is, by far.</div><article><h1>T</h1><p>Short.</article></body>"
    assert html_text.main_text(page) == "T Short."


@pytest.mark.parametrize(("name", "stays"), [("related-work", True), ("no-sidebar", True), ("header-image", True), ("search-results", True), ("post-form", False), ("blog-sidebar", False), ("ad-slot", False), ("related-posts", False), ("cookie_banner", False), ("menu", False), ("comments-area", False), ("ad 300x250", False)])
def test_marks_are_head_words(name, stays):
    page = f"<article>{BODY}<section class='{name}'><p>Other words, here.</p></section></article>"
    assert ("Other words, here." in html_text.main_text(page)) == stays


SENTENCE = "The scores, not the tags, decide. "


def page_of(parts):
    return "<html><body>" + "".join(parts) + "</body></html>"


def test_scores_decide_on_pages_without_articles():
    import itertools

    links = "<div class='box'>" + "<p><a href='/x'>" + SENTENCE * 4 + "</a></p>" * 3 + "</div>"
    short, long = f"<p>{SENTENCE * 2}</p>", f"<p>{SENTENCE * 9}</p>"
    for before, after, wrap in itertools.product(("", links, "<ul><li><a href='/'>Home</a></li></ul>"), ("", links), ("div", "section", "td")):
        inner = f"<h2>Head</h2>{long}{short}<blockquote>Quoted.</blockquote>{long}"
        body = f"<table><tr><td>{inner}</td></tr></table>" if wrap == "td" else f"<{wrap}>{inner}</{wrap}>"
        want = " ".join(["Head", (SENTENCE * 9).strip(), (SENTENCE * 2).strip(), "Quoted.", (SENTENCE * 9).strip()])
        assert html_text.main_text(page_of([before, body, after])) == want, (before, after, wrap)
    # Parts of the text in siblings, however short, and bare text between them.
    got = html_text.main_text(page_of([f"<div>{long}{long}</div>", "<div>A short part.</div>", "bare text", f"<section>{short}</section>", links]))
    assert got == " ".join([(SENTENCE * 9).strip()] * 2 + ["A short part.", "bare text", (SENTENCE * 2).strip()])
    # Of two containers the one with more and longer paragraphs, and commas.
    few, many = "<div><div><p>Short one.</p></div></div>", f"<div><div>{long}{long}</div></div>"
    assert (SENTENCE * 9).strip() in html_text.main_text(page_of([few, many]))


def test_extract_of_odd_tables(spark):
    rows = [(1, "u", f"<article>{BODY}</article>"), (1, "u", f"<article>{BODY}</article>"), (2, None, None), (None, "v", ""), (3, "w", "x " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit("clash")})
    got = sorted((tuple(r) for r in html_text.extract(df).collect()), key=str)
    assert got == sorted(((i, u, t := html_text.main_text(h), len(t)) for i, u, h in rows), key=str)
    assert html_text.extract(df.limit(0)).columns == ["page_id", "url", "text", "n_chars"] and html_text.extract(df.limit(0)).count() == 0


def test_string_ids_in_archives(spark):
    rows = [("a b/%", "u", "x"), ("z>\n", "u", "x"), (None, "u", "x"), ("\u00e9", None, None)]
    df = spark.createDataFrame(rows, "page_id string, url string, html string")
    got = {(r.page_id, r.record_type, r.refers_to) for r in warc.read(warc.write(df)).collect()}
    assert got == {("a b/%", "revisit", "z>\n"), ("z>\n", "response", None), (None, "revisit", "z>\n"), ("\u00e9", "response", None)}
    assert warc.file_system.__doc__ and warc.read(warc.write(df.limit(0))).schema["page_id"].dataType.simpleString() in ("string", "bigint")


def test_workers_forget_and_learn_again(docs):
    import pyarrow as pa

    texts = [r.text or "" for r in docs.orderBy("doc_id").limit(80).collect()]
    want = [library_ids(t) for t in texts]
    for remembered, size in ((50, 1 << 30), (1 << 30, 2000), (1 << 30, 1 << 30)):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(tokens, "REMEMBERED", remembered)
            patch.setattr(tokens, "REMEMBERED_BYTES", size)
            patch.setattr(tokens, "BLOCK_BYTES", 3000)
            got = [ids[at[i] : at[i + 1]].tolist() for _ in range(2) for b, ids, at in tokens.encode(pa.array(texts)) for i in range(len(b))]
        assert got == want * 2
    coder = tokens.coder(tokens.BPE)
    assert len(np.unique(coder.old[0])) == len(coder.old[0]) and not np.isin(coder.recent[0], coder.old[0]).any()
