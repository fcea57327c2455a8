"""Benchmark decontamination (10): suffix arrays over the training words, searched for every test suffix.

Each block of whole training documents (about SLICE_BYTES, or one longer text) is a shard. Its suffix array holds the
word positions at which a match of a whole window could begin: a run of words all of whose neighbouring pairs occur in
the test set. Other suffixes cannot match a window and are left out, which changes no result. Every test suffix is
binary-searched in every shard; the range of equal window prefixes gives all verbatim occurrences, the neighbours of the
range the longest match.

A window is `window` consecutive words of an item; an item with fewer words, but not none, is one window. Test sets
are broadcast in shards of at most TEST_WORDS words (or one longer item). A test set of one shard takes one pass over
the documents and no shuffle. A larger one takes a pass for each shard, each with that shard's broadcast alone, whose
findings (of texts that hold any) go to the shared folder, and are put together by the texts' digests.

Defined cases: null or empty text has no words, so n_words = n_hit = n_items = 0 and items_sha256 is that of ''.
Items whose id or text is null are ignored, equal ids count once, repeated documents are reported each on their own,
an empty benchmark hits nothing. `report` returns its own columns only, `clean` those of its input.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.cluster import cut, discard, prepare, tidied

WINDOW = 10
#: Words of one broadcast shard of the test set.
TEST_WORDS = 2_000_000
_FILTER_BITS = 20


class TestShard:
    """Word ids of some items with a separator 0 after each, their windows, and what can begin one."""

    __test__ = False  # not a test case

    def __init__(self, items: list[tuple[object, str]], window: int = WINDOW):
        column = pa.array([text for _, text in items], pa.large_string())
        ids, self.items = [], []
        hashes = []
        for block in tb.blocks(column):
            w = tb.words(block, tb.ALNUM)
            for i in range(len(block)):
                own = w.hashes[w.word_bounds[i] : w.word_bounds[i + 1]]
                if len(own):
                    hashes.append(own)
                    ids.append(str(items[block.first + i][0]))
        self.window = window
        self.items = ids
        self.vocabulary = np.unique(np.concatenate(hashes)) if hashes else np.empty(0, np.uint64)
        text, item, size, left = [], [], [], []
        for k, own in enumerate(hashes):
            n = len(own)
            text.append(np.append(np.searchsorted(self.vocabulary, own) + 1, 0))
            item.append(np.full(n + 1, k))
            size.append(np.full(n + 1, min(window, n)))
            left.append(np.arange(n, -1, -1))
        cat = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
        text, item, size, left = map(cat, (text, item, size, left))
        #: Suffixes that hold a whole window.
        self.suffixes = np.flatnonzero((size <= left) & (left > 0))
        self.longest = int(left.max()) if len(left) else 0
        self.text = np.append(text, np.zeros(self.longest + window + 1, np.int64))
        self.item, self.size, self.left = item, size, left
        sizes = size[self.suffixes]
        self.single = np.unique(self.vocabulary[self.text[self.suffixes[sizes == 1]] - 1]) if len(sizes) else self.vocabulary
        longer = sizes[sizes > 1]
        self.shortest = int(longer.min()) if len(longer) else 0
        pairs = [own[:-1] * np.uint64(tb._BASE) + own[1:] for own in hashes if len(own) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.uint64)
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[(self.pairs >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True

    def runs(self, w: tb.Words) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of the runs in which a window may lie."""
        h = w.hashes
        starts, lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        if self.shortest and len(h) > 1:
            pair = h[:-1] * np.uint64(tb._BASE) + h[1:]
            at = np.flatnonzero(self.maybe[(pair >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
            found = np.searchsorted(self.pairs, pair[at])
            found[found == len(self.pairs)] = 0
            at = at[self.pairs[found] == pair[at]]
            inner = w.word_bounds[1:-1]
            at = at[~np.isin(at, inner[inner > 0] - 1)]  # a pair across two documents
            if len(at):
                opens = np.concatenate(([True], np.diff(at) > 1))
                starts = at[opens]
                lengths = np.diff(np.append(np.flatnonzero(opens), len(at))) + 1
                keep = lengths >= self.shortest
                starts, lengths = starts[keep], lengths[keep]
        if len(self.single):
            alone = np.isin(h, self.single)
            alone[tb.ragged(starts, lengths)] = False
            alone = np.flatnonzero(alone)
            starts, lengths = np.append(starts, alone), np.append(lengths, np.ones(len(alone), np.int64))
        return starts, lengths


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the non-zero symbols in the order of their suffixes, by doubling until `depth` symbols are
    compared or all suffixes differ. Suffixes end at the symbol 0; ties are in order of position."""
    n = len(text)
    rank, width = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    while width < depth:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:]
        shifted[text == 0] = 0
        key = rank * (int(rank.max()) + 1) + shifted
        values, fresh = np.unique(key, return_inverse=True)
        rank, width = fresh.astype(np.int64), 2 * width
        if len(values) == np.count_nonzero(text) + 1:
            break
    order = np.argsort(rank, kind="stable")
    return order[text[order] != 0]


def bound(text: np.ndarray, order: np.ndarray, needles: np.ndarray, sizes: np.ndarray, after: bool) -> np.ndarray:
    """For each needle row, how many suffixes are less than (after: or begin with) its first `sizes` symbols."""
    lo, hi = np.zeros(len(needles), np.int64), np.full(len(needles), len(order))
    steps = np.arange(needles.shape[1])
    within = steps < sizes[:, None]
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        seen = text[order[np.minimum(mid, len(order) - 1)][:, None] + steps]
        differs = (seen != needles) & within
        first = differs.argmax(axis=1)
        rows = np.arange(len(needles))
        less = np.where(differs.any(axis=1), seen[rows, first] < needles[rows, first], after)
        lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
    return lo


def occurrences(w: tb.Words, test: TestShard) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Test suffix, first word, and words of the longest verbatim match, for each place where the suffix's window
    stands in the block. Words count from the block's first."""
    none = np.empty(0, np.int64)
    starts, lengths = test.runs(w)
    if not len(starts):
        return none, none, none
    places = tb.ragged(starts, lengths)
    ids = np.searchsorted(test.vocabulary, w.hashes[places]) + 1
    slot = np.arange(len(places)) + np.repeat(np.arange(len(starts)), lengths)  # a separator after each run
    text = np.zeros(int(slot[-1]) + 2 + test.longest + test.window, np.int64)
    text[slot] = ids
    origin = np.zeros(len(text), np.int64)
    origin[slot] = places
    order = suffix_array(text, test.longest)
    near = test.suffixes[np.isin(test.text[test.suffixes], np.unique(ids))]
    if not len(near):
        return none, none, none
    sizes = test.size[near]
    needles = test.text[near[:, None] + np.arange(int(sizes.max()))]
    lo, hi = bound(text, order, needles, sizes, False), bound(text, order, needles, sizes, True)
    which = np.repeat(np.arange(len(near)), hi - lo)
    at = order[tb.ragged(lo, hi - lo)]
    reach, most = sizes[which].copy(), test.left[near[which]]
    grow = np.flatnonzero(reach < most)
    while len(grow):
        same = text[at[grow] + reach[grow]] == test.text[near[which[grow]] + reach[grow]]
        grow = grow[same]
        reach[grow] += 1
        grow = grow[reach[grow] < most[grow]]
    return near[which], origin[at], reach


def _findings(w: tb.Words, test: TestShard, n: int) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """First words and ends (in the block) of all windows' occurrences, and the items found in each text."""
    items: list[set[str]] = [set() for _ in range(n)]
    suffix, at, _ = occurrences(w, test)
    if len(at):
        row = np.searchsorted(w.word_bounds, at, side="right") - 1
        for r, k in np.unique(np.stack([row, test.item[suffix]]), axis=1).T.tolist():
            items[r].add(test.items[k])
        return at, at + test.size[suffix], items
    return at, at, items


def _covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """For each word count, how many of the words before it lie in a span."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, ends, -1)
    return np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]) > 0)))


def _shards(benchmark: DataFrame, window: int) -> Iterator[TestShard]:
    """The test set in item order, one shard at a time."""
    rows, size, any_ = [], 0, False
    ordered = benchmark.select("item_id", "text").where("item_id is not null and text is not null").orderBy("item_id", "text")
    for row in ordered.toLocalIterator():
        rows.append((row[0], row[1]))
        size += len(row[1]) // 2 + 1
        if size >= TEST_WORDS:
            yield TestShard(rows, window)
            rows, size, any_ = [], 0, True
    if rows or not any_:
        yield TestShard(rows, window)


def _only(shards: Iterator[TestShard]) -> tuple[TestShard | None, Iterator[TestShard]]:
    """The single shard of a test set that has no more, or None and all of them."""
    first = next(shards)
    second = next(shards, None)
    if second is None:
        return first, iter(())
    return None, itertools.chain([first, second], shards)


REPORT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("items", pa.list_(pa.string()))])
REPORT_SQL = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>"


def _report(ids: pa.Array, n: np.ndarray, hit: np.ndarray, items: list[list[str]]) -> pa.RecordBatch:
    columns = [n, hit, [len(x) for x in items], [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], hit > 0, items]
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, f.type) for c, f in zip(columns, REPORT, strict=True))], ["doc_id", *REPORT.names])


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items: one row per row of docs."""
    spark = prepare(docs.sparkSession)
    source = docs.select("doc_id", "text")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {REPORT_SQL}"
    single, shards = _only(_shards(benchmark, window))
    if single is not None:
        test = spark.sparkContext.broadcast(single)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in tb.blocks(batch.column("text")):
                    w = tb.words(block, tb.ALNUM)
                    starts, ends, items = _findings(w, test.value, len(block))
                    hit = _covered(starts, ends, len(w.hashes))
                    yield _report(batch.column("doc_id").slice(block.first, len(block)), np.diff(w.word_bounds), np.diff(hit[w.word_bounds]), [sorted(x) for x in items])

        return source.mapInArrow(run, schema)

    spans = "digest binary, starts array<long>, ends array<long>, items array<string>"
    parts = []
    for shard in shards:
        test = spark.sparkContext.broadcast(shard)

        @tidied
        def one(batches: Iterator[pa.RecordBatch], test=test) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in tb.blocks(batch.column("text")):
                    w = tb.words(block, tb.ALNUM)
                    starts, ends, items = _findings(w, test.value, len(block))
                    order = np.argsort(starts, kind="stable")
                    starts, ends = starts[order], ends[order]
                    edges = np.searchsorted(starts, w.word_bounds)
                    some = [i for i in range(len(block)) if edges[i] < edges[i + 1]]
                    own = [slice(edges[i], edges[i + 1]) for i in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([_digest(block, i) for i in some], pa.binary()), *(pa.array([x[o] - w.word_bounds[i] for i, o in zip(some, own, strict=True)], pa.list_(pa.int64())) for x in (starts, ends)), pa.array([sorted(items[i]) for i in some], pa.list_(pa.string()))],
                        ["digest", "starts", "ends", "items"],
                    )

        # Equal texts have equal findings: one row a digest, chosen in each task before the shuffle.
        found = source.mapInArrow(one, spans)
        parts.append(cut(found.groupBy("digest").agg(*[F.any_value(c).alias(c) for c in ("starts", "ends", "items")]), "leaks"))
        test.destroy()

    @tidied
    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                w = tb.words(block, tb.ALNUM)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(block.first, len(block)), pa.array([_digest(block, i) for i in range(len(block))], pa.binary()), pa.array(np.diff(w.word_bounds))], ["doc_id", "digest", "n_words"])

    @tidied
    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.asarray(batch.column("n_words"))
            hit = [int(_covered(np.array(s or [], np.int64), np.array(e or [], np.int64), int(words))[-1]) for s, e, words in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), n, strict=True)]
            yield _report(batch.column("doc_id"), n, np.array(hit, np.int64), [x or [] for x in batch.column("items").to_pylist()])

    every = functools.reduce(DataFrame.unionByName, parts)
    merged = cut(every.groupBy("digest").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")), "leaks")
    rows = cut(source.mapInArrow(digests, f"{schema.split(',')[0]}, digest binary, n_words long"), "leak-rows")
    discard(*parts)
    return rows.join(merged, "digest", "left").mapInArrow(put_together, schema)


def _digest(block: tb.Block, i: int) -> bytes:
    return hashlib.sha256(block.text(i)).digest()


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of the benchmark occurs; a pass for each shard."""
    spark = prepare(docs.sparkSession)
    where = docs.columns.index("text")

    def without(rows: DataFrame, shard: TestShard) -> DataFrame:
        test = spark.sparkContext.broadcast(shard)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = []
                for block in tb.blocks(batch.column(where)):
                    w = tb.words(block, tb.ALNUM)
                    starts, ends, _ = _findings(w, test.value, len(block))
                    hits.append(np.diff(_covered(starts, ends, len(w.hashes))[w.word_bounds]))
                if hits:
                    yield batch.filter(pa.array(np.concatenate(hits) == 0))

        return rows.mapInArrow(run, docs.schema)

    single, shards = _only(_shards(benchmark, window))
    if single is not None:
        return without(docs, single)
    rows = docs
    for shard in shards:
        last, rows = rows, cut(without(rows, shard), "clean")
        if last is not docs:
            discard(last)
    return rows


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, item_word, doc_id, doc_word, length: every verbatim match that begins with a window, at full length."""
    spark = prepare(docs.sparkSession)
    source = docs.select("doc_id", "text")

    def one(shard: TestShard) -> DataFrame:
        test = spark.sparkContext.broadcast(shard)

        @tidied
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in tb.blocks(batch.column("text")):
                    w, own = tb.words(block, tb.ALNUM), test.value
                    suffix, at, reach = occurrences(w, own)
                    row = np.searchsorted(w.word_bounds, at, side="right") - 1
                    first = np.searchsorted(own.item, own.item[suffix])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([own.items[k] for k in own.item[suffix]], pa.string()), pa.array(suffix - first), batch.column("doc_id").take(pa.array(block.first + row)), pa.array(at - w.word_bounds[row]), pa.array(reach)],
                        ["item_id", "item_word", "doc_id", "doc_word", "length"],
                    )

        return source.mapInArrow(run, f"item_id string, item_word long, doc_id {source.schema['doc_id'].dataType.simpleString()}, doc_word long, length long")

    single, shards = _only(_shards(benchmark, window))
    return one(single) if single is not None else functools.reduce(DataFrame.unionByName, [cut(one(shard), "matches") for shard in shards])
