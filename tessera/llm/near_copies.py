"""N-gram Jaccard join (1): an exact self-join of documents on their sets of k-word shingles.

The matrix has a row for each distinct set and a column for each shingle. Its product with its transpose holds the
overlaps of all pairs; only entries that can reach the threshold are worked out:

1. Equal sets are one row (by a 128-bit digest), so groups of exact copies cost no pairs.
2. A pair over the threshold misses at most miss(n) of a set's n shingles. Of the first miss(n) + k shingles in hash
   order both rows of such a pair share k, so a row that has fewer than k of them in other rows has no partner. The
   column counts for that are merged by blocks of rows, one entry for each block and column.
3. For the rows left, all columns are counted the same way. A column with a single row adds to no overlap: it only
   counts, as `own`, in the row's size. Rows with more than miss(n) of these go. Rows with the same shared columns
   are one class, whose least `own` row stands for it.
4. Classes meet in blocks of a column (rare columns first; a class needs only the miss(n) - own + 1 first). A block's
   pairs are dropped by the bounds that their sizes give: on the size ratio, on the columns that neither can spare,
   and on the difference of 256-bit parity sketches, which is never above the sets' difference. Columns with many
   rows are dealt out as pairs of chunks.
5. The overlap of each pair left is accumulated over all shared columns, which decides it exactly.

Members of a class link to the class representative or to a linked one exactly if their `own` is at most the class's
reach, the largest sum that its links leave; components follow by alternating star steps over the class links. No
pairs within a class are made, and no rows grow with the square of a group of copies. Every link is decided, but links
of hot columns that join nothing new are not rows: `link_counts` adds them up in their block, once, for each `own` of
either class, and gives every document the number of other distinct sets that its set links to.

Defined cases: null or empty text, or text without words, has n_shingles 0 and is linked with nothing, so its
component is its own doc_id and it has no links. Copies of one set are no links. A text of fewer than k words is one
shingle. Repeated rows and ties link like any copies. A row without doc_id links like any other and gets its group's
smallest doc_id, or null if the group has none; rows of one doc_id with differing texts are documents of their own.
Only doc_id and text of the input are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.cluster import cut, discard, key_join, partitions, prepare, tidied, trim

#: Rows of (digest, id) or (node, node) that are broadcast at most.
FEW = 300_000

#: Bits of a parity sketch, in 64-bit words.
SKETCH = 4
#: Rows of a chunk of a column with more rows than that.
CHUNK = 2048
#: A column with more rows than this brings the classes' shingles along: its links are decided in its block.
HOT = 32
#: A posting brings the columns before its own, if not more: a pair is made only where its first common column is.
BEFORE = 32
#: Shingles of one block of rows whose column counts are merged before they are sent.
BLOCK_GRAMS = 1 << 19


class Rule:
    """Two sets link when q * intersection >= p * union."""

    def __init__(self, k: int, p: int, q: int):
        self.k, self.p, self.q = k, p, q

    def miss(self, n):
        return n * (self.q - self.p) // self.q

    def spare(self, n):
        """k of step 2: any number from 1 on is right; half of miss(n) rules out most rows and keeps heads short."""
        return -(-n * (self.q - self.p) // (2 * self.q))

    def needed(self, n):
        """Least k of any row that links to one of n shingles."""
        least = -(-n * self.p // self.q)
        return np.maximum(1, np.minimum(self.spare(n), self.spare(least)))


def _digest(grams: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(grams.tobytes())


def _blobs(values: list[np.ndarray]) -> pa.Array:
    return pa.array([x.tobytes() for x in values], pa.binary())


def _blob(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint64)


def _sets(column: pa.Array, k: int) -> Iterator[tuple[tb.Block, list[np.ndarray]]]:
    for block in tb.blocks(column):
        w = tb.words(block, tb.NOT_SPACE)
        grams = tb.gram_hashes(w, k)
        yield block, [tb.shingle_sets(w, i, grams, k) for i in range(len(block))]


def _rows(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, row (a number of its own), n, sig (null without words), head: the first shingles in hash order."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for block, sets in _sets(batch.column("text"), rule.k):
                row += len(block)
                head = [x[: int(rule.miss(len(x)) + rule.spare(len(x)))] for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(block.first, len(block)), pa.array(np.arange(row - len(block), row)), pa.array([len(x) for x in sets], pa.int64()), pa.array([_digest(x) if len(x) else None for x in sets], pa.binary()), _blobs(head)],
                    ["doc_id", "row", "n", "sig", "head"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, row long, n long, sig binary, head binary")


def _columns(rows: DataFrame, grams: str) -> DataFrame:
    """block, bucket, count of rows and the distinct shingles of each block of rows, cut by bucket of columns."""
    buckets = 4 * partitions(rows.sparkSession)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, blobs in zip(batch.column("block").to_pylist(), batch.column(grams).to_pylist(), strict=True):
                columns, counts = np.unique(np.concatenate([_blob(x) for x in blobs]), return_counts=True)
                bucket = (columns >> np.uint64(32)).astype(np.int64) * buckets >> 32
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edges))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), number)), pa.array(some), _blobs([columns[edges[b] : edges[b + 1]] for b in some]), _blobs([counts[edges[b] : edges[b + 1]].astype(np.uint32) for b in some])],
                    ["block", "bucket", "columns", "counts"],
                )

    return rows.mapInArrow(run, "block long, bucket long, columns binary, counts binary")


def _merged(sent: DataFrame) -> DataFrame:
    """block, columns, counts: of each block's columns those with two rows or more in all blocks."""

    def run(table: pa.Table) -> pa.Table:
        trim()
        parts = [_blob(x) for x in table["columns"].to_pylist()]
        counts = [np.frombuffer(x, np.uint32).astype(np.int64) for x in table["counts"].to_pylist()]
        values, which = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)[which]
        out, sums, at = [], [], 0
        for x in parts:
            own = total[at : at + len(x)]
            at += len(x)
            out.append(x[own > 1])
            sums.append(own[own > 1].astype(np.uint64))
        return pa.table({"block": table["block"], "columns": _blobs(out), "counts": _blobs(sums)})

    return sent.groupBy("bucket").applyInArrow(run, "block long, columns binary, counts binary")


def _gathered(rows: Iterator[tuple], number: int) -> Iterator[pa.RecordBatch]:
    """Rows of sig, n, shingles as blocks of bounded size, numbered from `number`."""
    sigs, ns, blobs, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([number]), pa.array([sigs], pa.list_(pa.binary())), pa.array([ns], pa.list_(pa.int64())), pa.array([blobs], pa.list_(pa.binary()))], ["block", "sigs", "ns", "grams"]
        )

    for sig, n, blob in rows:
        sigs.append(sig)
        ns.append(n)
        blobs.append(blob)
        size += len(blob) // 8
        if size >= BLOCK_GRAMS:
            yield out()
            number += 1
            sigs, ns, blobs, size = [], [], [], 0
    if sigs:
        yield out()


def _blocked(rows: DataFrame, grams: str, k: int | None = None) -> DataFrame:
    """Rows of sig, n and shingles gathered to blocks of bounded size: block, sigs, ns, and their shingles.

    k: rows hold a text in `grams`; its k-word shingles are taken in the same worker."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                sigs = batch.column("sig").to_pylist()
                if k is None:
                    yield from zip(sigs, batch.column("n").to_pylist(), batch.column(grams).to_pylist(), strict=True)
                    continue
                for block, sets in _sets(batch.column(grams), k):
                    yield from ((sigs[block.first + i], len(x), x.tobytes()) for i, x in enumerate(sets))

        # Numbers of texts' blocks lie apart from those of other rows' blocks.
        yield from _gathered(each(), 2 * TaskContext.get().partitionId() + (k is not None) << 32)

    return rows.select("sig", *["n"] * (k is None), grams).mapInArrow(run, "block long, sigs array<binary>, ns array<long>, grams array<binary>")


def _with_counts(blocked: DataFrame, step, schema: str) -> DataFrame:
    """step(sig, n, shingles, count of rows of each) for every row, the counts merged over all blocks."""
    merged = _merged(_columns(blocked.select("block", "grams"), "grams"))

    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        trim()
        shared = np.concatenate([np.empty(0, np.uint64), *[_blob(x) for x in replies["columns"].to_pylist()]])
        counts = np.concatenate([np.empty(0, np.uint64), *[_blob(x) for x in replies["counts"].to_pylist()]])
        order = np.argsort(shared)
        shared, counts = np.append(shared[order], np.uint64(0)), np.append(counts[order], np.uint64(1))
        out = []
        for sigs, ns, blobs in zip(rows["sigs"].to_pylist(), rows["ns"].to_pylist(), rows["grams"].to_pylist(), strict=True):
            for sig, n, blob in zip(sigs, ns, blobs, strict=True):
                grams = _blob(blob)
                at = np.searchsorted(shared[:-1], grams)
                found = step(sig, n, grams, np.where(shared[at] == grams, counts[at], np.uint64(1)).astype(np.int64))
                if found is not None:
                    out.append(found)
        types = result.types
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], schema=result)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    result = to_arrow_schema(_parse_datatype_string(schema))
    return blocked.groupBy("block").cogroup(merged.groupBy("block")).applyInArrow(run, schema)


def _classes(rule: Rule):
    """Step 3 for one row: sig, class digest, own, its shared shingles in order of count."""

    def step(sig, n, grams, counts):
        shared = counts > 1
        own = n - int(shared.sum())
        if own > rule.miss(n):
            return None
        order = np.lexsort((grams[shared], counts[shared]))
        return sig, _digest(grams[shared]), own, grams[shared][order].tobytes(), counts[shared][order][: int(rule.miss(n)) - own + 1].astype(np.uint64).tobytes()

    return step


def _sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles that fall on each bit."""
    bits = np.bincount((tb.mix(grams) >> np.uint64(56)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.uint64)


def _postings(classes: DataFrame, rule: Rule) -> DataFrame:
    """column, part, side, and the class's digest, size and sketch for each column that it must be met in.

    Postings of hot columns bring the class's shingles in order of count, the column's place in them, and the numbers
    of members by `own`."""

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["column", "part", "side", "cls", "size", "own", "sketch", "before", "place", "shared", "more", "owns", "nums"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        out: list[tuple] = []
        held = 0
        for batch in batches:
            for cls, u, blob, counts, more, owns, nums in zip(*(batch.column(c).to_pylist() for c in ("cls", "own", "grams", "counts", "more", "owns", "nums")), strict=True):
                grams = _blob(blob)
                bits = _sketch(grams).tobytes()
                need = int(rule.miss(len(grams) + u)) - u + 1
                keys = grams[:need].view(np.int64).tolist()
                for i, (g, c) in enumerate(zip(keys, _blob(counts)[:need].tolist(), strict=False)):
                    chunks = -(-c // CHUNK)
                    mine = int.from_bytes(cls[:8], "little") % chunks
                    out += [(g, min(mine, x) * chunks + max(mine, x), 0 if mine == x else 1 + (mine > x), cls, len(grams), u, bits, keys[:i] if c <= HOT and i <= BEFORE else None, i, *((blob, more, owns, nums) if c > HOT else (None, more, None, None))) for x in range(chunks)]
                held += len(blob) * len(keys)
                if len(out) > 50_000 or held > 8_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return classes.mapInArrow(run, "column long, part long, side int, cls binary, size long, own long, sketch binary, before array<long>, place long, shared binary, more boolean, owns array<long>, nums array<long>")


def _block_pairs(who: np.ndarray, side: np.ndarray, size: np.ndarray, own: np.ndarray, bits: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one column's rows that their sizes and sketches do not rule out."""
    order = np.lexsort((who, size + own))
    side, size, own, bits = side[order], size[order], own[order], bits[order]
    total = size + own
    left, right = [], []
    for i in range(len(order) - 1):
        # Rows are in order of size: partners end where the size ratio does.
        end = int(np.searchsorted(total, total[i] * rule.q // rule.p, side="right"))
        if end <= i + 1:
            continue
        j = slice(i + 1, end)
        # The difference of a linked pair is at most (q - p) / (q + p) of both sizes together.
        room = (rule.q - rule.p) * (total[j] + total[i]) // (rule.q + rule.p) - own[i] - own[j]
        apart = np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1).astype(np.int64)
        good = (apart <= room) & ((side[j] != side[i]) | (side[i] == 0))
        found = np.flatnonzero(good) + i + 1
        left.append(np.full(len(found), i))
        right.append(found)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _overlaps(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of common values of sets x[i] and y[i]; equal x stand together. Accumulated over columns, by their rows."""
    out = np.zeros(len(x), np.int64)
    m, total = len(sets), sum(len(v) for v in sets)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    runs = list(zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=False))
    pieces = 1 + (total >> 22)
    for piece in range(pieces):  # so many columns at a time that their index stays small
        own = [v[v % np.uint64(pieces) == piece] for v in sets] if pieces > 1 else sets
        bounds = np.cumsum([0, *map(len, own)])
        if not bounds[-1]:
            continue
        ids = np.unique(np.concatenate(own), return_inverse=True)[1]
        counts = np.bincount(ids)
        starts = np.cumsum(counts) - counts
        owners = np.repeat(np.arange(m, dtype=np.int32), np.diff(bounds))[np.argsort(ids, kind="stable")]
        for low, high in runs:
            mine = ids[bounds[x[low]] : bounds[x[low] + 1]]
            mine = mine[counts[mine] > 1]
            for part in np.array_split(mine, 1 + (len(mine) * m >> 20)):
                if len(part):
                    n = counts[part]
                    at = np.arange(int(n.sum())) + np.repeat(starts[part] - (np.cumsum(n) - n), n)
                    out[low:high] += np.bincount(owners[at], minlength=m)[y[low:high]]
    return out


def _ranges(bounds: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the entries of each of `which`, and how many each has."""
    n = bounds[which + 1] - bounds[which]
    return np.arange(int(n.sum())) + np.repeat(bounds[which] - (np.cumsum(n) - n), n), n


def _hot(x: np.ndarray, y: np.ndarray, sets: list[np.ndarray], place: np.ndarray, own: np.ndarray, hist: list[tuple[list[int], list[int]]] | None, rule: Rule) -> tuple[list[tuple[int, int, int]], np.ndarray, list[np.ndarray] | None]:
    """All links of the pairs x, y that meet first in a hot column's block.

    Gives the links that join two components of the block, with their largest sum of `own`; each row's reach (-1
    without links); and with the numbers of members by `own`, the number of members that each of these links to."""
    m = len(sets)
    reach = np.full(m, -1, np.int64)
    fresh = _overlaps([v[:n] for v, n in zip(sets, place.tolist(), strict=True)], x, y) == 0
    x, y = x[fresh], y[fresh]
    size = np.array([len(v) for v in sets], np.int64)
    most = ((rule.q + rule.p) * _overlaps(sets, x, y) - rule.p * (size[x] + size[y])) // rule.p
    good = most >= own[x] + own[y]
    x, y, most = x[good], y[good], most[good]
    label, joins = np.arange(m), []
    if hist is not None:
        bounds = np.cumsum([0, *(len(u) for u, _ in hist)])
        owns, nums = (np.array([v for h in hist for v in h[k]], np.int64) for k in (0, 1))
        counts = np.zeros(len(owns), np.int64)
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.empty(0, np.int64)
    for low, high in zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=False):
        i, j, r = int(x[low]), y[low:high], most[low:high]
        reach[i] = max(reach[i], int((r - own[j]).max()))
        reach[j] = np.maximum(reach[j], r - own[i])
        other, at = np.unique(label[j], return_index=True)
        at = at[other != label[i]]
        joins += [(i, int(j[t]), int(r[t])) for t in at]
        label[np.isin(label, other)] = label[i]
        if hist is not None:
            mine = slice(bounds[i], bounds[i + 1])
            flat, n = _ranges(bounds, j)
            # Of row i's different `own`, so many are low enough for each `own` of its partners.
            fit = np.searchsorted(owns[mine], np.repeat(r, n) - owns[flat], side="right")
            counts[flat] += np.concatenate(([0], np.cumsum(nums[mine])))[fit]
            by = np.zeros(len(owns[mine]) + 1, np.int64)
            np.add.at(by, fit, nums[flat])
            counts[mine] += by[::-1].cumsum()[::-1][1:]
    return joins, reach, np.split(counts, bounds[1:-1]) if hist is not None else None


def _candidates(postings: DataFrame, rule: Rule) -> DataFrame:
    """kind, a, b, most, counts: what the blocks of the columns find.

    kind 0: a and b meet in a block and may link. In blocks of hot columns overlaps are accumulated at once, for every
    pair that meets first there. Only links that join two components of the block are given (kind 1, with `most`), so
    their number is that of the rows; classes with several members also get their reach there (kind 2, in `most`), and
    if links are counted every class gets the numbers of its links there by `own` (kind 3, in `counts`)."""
    n = partitions(postings.sparkSession)
    dealt = postings.repartition(n, "column", "part").sortWithinPartitions("column", "part")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.stack([t["column"].to_numpy(), t["part"].to_numpy()])
            edges = np.concatenate(([0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [t.num_rows]))
            who = np.array(t["cls"].to_pylist(), dtype=object)
            side, size, own, place = (t[c].to_numpy() for c in ("side", "size", "own", "place"))
            bits = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint64).reshape(-1, SKETCH)
            rank = np.unique(who.astype("S16"), return_inverse=True)[1] if len(who) else who
            before = [frozenset(x or ()) for x in t["before"].to_pylist()]
            shared, more, owns, nums = t["shared"], t["more"].to_pylist(), t["owns"].to_pylist(), t["nums"].to_pylist()
            found: set[tuple] = set()
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if b - a < 2:
                    continue
                x, y = _block_pairs(rank[a:b], side[a:b], size[a:b], own[a:b], bits[a:b], rule)
                if len(x) and shared[a].is_valid:
                    some, at = np.unique(np.concatenate([x, y]), return_inverse=True)
                    rows = (some + a).tolist()
                    hist = None if owns[a] is None else [(owns[r], nums[r]) for r in rows]
                    joins, reach, counts = _hot(at[: len(x)], at[len(x) :], [_blob(shared[r].as_py()) for r in rows], place[rows], own[rows], hist, rule)
                    found.update((1, min(who[rows[i]], who[rows[j]]), max(who[rows[i]], who[rows[j]]), most, None) for i, j, most in joins)
                    found.update((2, who[r], who[r], int(reach[i]), None) for i, r in enumerate(rows) if more[r] and reach[i] >= 0)
                    if counts is not None:
                        # Named by its block, so that equal counts of two blocks stay two rows.
                        block = key[:, a].tobytes()
                        found.update((3, who[r], block, None, tuple(counts[i].tolist())) for i, r in enumerate(rows) if counts[i].any())
                    continue
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    p, r = a + i, a + j
                    if who[p] != who[r] and before[p].isdisjoint(before[r]):
                        found.add((0, min(who[p], who[r]), max(who[p], who[r]), None, None))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["kind", "a", "b", "most", "counts"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            column, part = held["column"].to_numpy(), held["part"].to_numpy()
            done = int(np.flatnonzero((column != column[-1]) | (part != part[-1]))[-1] + 1) if ((column != column[-1]) | (part != part[-1])).any() else 0
            if done:  # the last block of a column may go on in the next batch
                yield from pairs(held.slice(0, done).combine_chunks())
                held = held.slice(done)
        if held is not None and held.num_rows:
            yield from pairs(held.combine_chunks())

    return dealt.mapInArrow(run, "kind int, a binary, b binary, most long, counts array<long>").distinct()


def _most(x: np.ndarray, y: np.ndarray, rule: Rule) -> int:
    """Largest sum of `own` with which rows of these shared shingles link, from their accumulated overlap."""
    if not len(x) or not len(y):
        return -1
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    return ((rule.q + rule.p) * int((x[at] == y).sum()) - rule.p * (len(x) + len(y))) // rule.p


def _links(pairs: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """a, b, most: linked classes, and the largest sum of the two `own` with which members of theirs link."""
    rows = classes.select("cls", "own", "grams")
    left = rows.select(F.col("cls").alias("a"), F.col("own").alias("own_a"), F.col("grams").alias("grams_a"))
    right = rows.select(F.col("cls").alias("b"), F.col("own").alias("own_b"), F.col("grams").alias("grams_b"))

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most, keep = [], []
            for own_a, x, own_b, y in zip(*(batch.column(c).to_pylist() for c in ("own_a", "grams_a", "own_b", "grams_b")), strict=True):
                most.append(_most(np.sort(_blob(x)), np.sort(_blob(y)), rule))
                keep.append(most[-1] >= own_a + own_b)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(most, pa.int64())], ["a", "b", "most"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary, most long")


def _counted(links: DataFrame, met: DataFrame, classes: DataFrame, rule: Rule) -> DataFrame:
    """cls, n_links: for each class a map from its members' `own` to the number of sets that such a member links to.

    links are those of kind 0; the numbers of kind 3 are added, and the links within the class."""
    own = classes.select("cls", "owns", "nums")
    left = own.select(F.col("cls").alias("a"), F.col("owns").alias("owns_a"), F.col("nums").alias("nums_a"))
    right = own.select(F.col("cls").alias("b"), F.col("owns").alias("owns_b"), F.col("nums").alias("nums_b"))
    below = "transform({0}, u -> aggregate(zip_with({1}, {2}, (v, n) -> if(u + v <= {3}, n, 0L)), 0L, (s, n) -> s + n))"
    cold = links.join(left, "a").join(right, "b")
    rows = cold.select(F.col("a").alias("cls"), F.expr(below.format("owns_a", "owns_b", "nums_b", "most")).alias("counts"))
    rows = rows.unionByName(cold.select(F.col("b").alias("cls"), F.expr(below.format("owns_b", "owns_a", "nums_a", "most")).alias("counts")))
    rows = rows.unionByName(met.where("kind = 3").select(F.col("a").alias("cls"), "counts"))
    # A member of low `own` meets itself in its class as well.
    room = f"length(grams) div 8 * {rule.q - rule.p} div {rule.p}"
    inner = below.format("owns", "owns", "nums", room)
    rows = rows.unionByName(classes.select("cls", F.expr(f"zip_with({inner}, owns, (c, u) -> c - if(2 * u <= {room}, 1L, 0L))").alias("counts")))
    sums = rows.select("cls", F.posexplode("counts").alias("place", "n")).groupBy("cls", "place").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("place", "n"))).alias("sums"))
    return sums.join(own, "cls").select("cls", F.map_from_arrays("owns", F.col("sums.n")).alias("n_links"))


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """node, root for every node of the links a, b: root is the least node of its component.

    Alternating large-star and small-star steps; every round is written to the shared folder. The least neighbours are
    tables of their own, so AQE can split a node with very many links in the joins."""
    edges = cut(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), name, tidy=False)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = cut(both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m")), name, tidy=False)
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        large = cut(large.where("v <> u").distinct(), name, tidy=False)
        least = cut(large.groupBy("v").agg(F.min("u").alias("m")), name, tidy=False)
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u")))
        old, edges = edges, cut(small.where("v <> u").distinct(), name, tidy=False)
        discard(old, low, large, least)
        n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if (n, total) == before:
            break
        before = (n, total)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def join(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; links at q * intersection >= p * union."""
    return _joined(docs, k, p, q, False).select("doc_id", "n_shingles", "component_id")


def link_counts(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """The columns of join() and n_links: how many other distinct sets of docs the row's set links to."""
    return _joined(docs, k, p, q, True).select("doc_id", "n_shingles", "component_id", "n_links")


def _with_sig(docs: DataFrame, k: int, extra: str, kind: str) -> DataFrame:
    """The rows of docs with the digest of each text's set (null without words) or, for kind "set", also its size and
    shingles as `n` and `grams`."""
    where = docs.columns.index("text")
    whole = kind == "set"

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sets in _sets(batch.column(where), k):
                own = batch.slice(block.first, len(block))
                more = [pa.array([_digest(x) if len(x) else None for x in sets], pa.binary())]
                if whole:
                    more += [pa.array([len(x) for x in sets], pa.int64()), _blobs(sets)]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*own.schema.names, extra, *["n", "grams"] * whole])

    from pyspark.sql.types import BinaryType, LongType, StructField, StructType

    fields = [StructField(extra, BinaryType()), *[StructField("n", LongType()), StructField("grams", BinaryType())] * whole]
    return docs.mapInArrow(run, StructType([*docs.schema.fields, *fields]))


def _unnamed(docs: DataFrame, again: DataFrame) -> DataFrame:
    """The rows that their doc_id does not name: it is null, or several rows have it."""
    return docs.where("doc_id is null").unionByName(key_join(docs, again, ["doc_id"], "left_semi", rows=FEW))


def _repeated(names: DataFrame) -> DataFrame:
    return cut(names.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated", tidy=False)


def _joined(docs: DataFrame, k: int, p: int, q: int, count: bool) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, sig, and stays: whether the row is of its component's first set."""
    prepare(docs.sparkSession)
    rule = Rule(k, p, q)
    rows = cut(_rows(docs, rule), "sets")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    distinct = rows.where("sig is not null").groupBy("sig").agg(F.min("doc_id").alias("least"), F.min_by("row", order).alias("first_row"), (F.count("*") > 1).alias("copied"))
    distinct = cut(distinct, "distinct")

    names = cut(rows.select("doc_id", "n", "sig"), "names")
    again = _repeated(names)

    # Step 2: of each distinct set one row brings the head.
    copies = cut(rows.where("sig is not null").select("sig", "row").join(distinct.where("copied").select("sig", "first_row"), "sig").where("row <> first_row").select("row"), "copies", tidy=False)
    heads = key_join(rows.where("sig is not null").select("row", "sig", "n", "head"), copies, ["row"], "left_anti", rows=1_000_000)
    blocked = cut(_blocked(heads, "head"), "heads")

    def alive(sig, n, grams, counts):
        return (sig,) if int((counts > 1).sum()) >= min(rule.needed(n), len(grams)) else None

    living = cut(_with_counts(blocked, alive, "sig binary"), "living")
    del heads
    discard(rows, blocked, copies)

    # Step 3: whole sets of the rows left. A doc_id of one row leads to its text; other texts are found by their digest.
    texts = docs.select("doc_id", "text")
    owners = living.join(distinct, "sig").select("sig", F.col("least").alias("doc_id"))
    by_id = cut(key_join(owners.where("doc_id is not null"), again, ["doc_id"], "left_anti", rows=FEW), "owners", tidy=False)
    by_sig = cut(owners.where("doc_id is null").unionByName(key_join(owners, again, ["doc_id"], "left_semi", rows=FEW)).select("sig"), "owners", tidy=False)

    # Texts become blocks of shingles in one worker a task: two workers in a row would each keep their memory.
    full = _blocked(key_join(texts, by_id, ["doc_id"], "inner", rows=FEW), "text", k)
    if not by_sig.isEmpty():
        others = key_join(_with_sig(_unnamed(texts, again), k, "sig", "set").select("sig", "n", "grams"), by_sig, ["sig"], "left_semi", rows=FEW)
        full = full.unionByName(_blocked(others.groupBy("sig").agg(F.any_value("n").alias("n"), F.any_value("grams").alias("grams")), "grams"))
    blocked = cut(full, "whole")
    members = cut(_with_counts(blocked, _classes(rule), "sig binary, cls binary, own long, grams binary, counts binary"), "members")
    del full
    discard(blocked, living, by_id, by_sig, again)

    # Steps 4 and 5, between the classes.
    heads_of = members.groupBy("cls").agg(F.min("own").alias("own"), (F.count("*") > 1).alias("more"))
    classes = members.select("sig", "cls", "own", "grams", "counts").join(heads_of, ["cls", "own"]).dropDuplicates(["cls"])
    if count:
        by_own = members.groupBy("cls", "own").agg(F.count("*").alias("n")).groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("own", "n"))).alias("h"))
        classes = classes.join(by_own.select("cls", F.col("h.own").alias("owns"), F.col("h.n").alias("nums")), "cls")
    else:
        classes = classes.withColumns({c: F.lit(None).cast("array<long>") for c in ("owns", "nums")})
    classes = cut(classes, "classes")
    members = cut(members.select("sig", "cls", "own"), "members-of", tidy=False)
    met = cut(_candidates(_postings(classes, rule), rule), "pairs")
    decided = met.where("kind = 1").select("a", "b", "most")
    cold = cut(_links(met.where("kind = 0").select("a", "b"), classes, rule), "links")
    links = cold.unionByName(decided)

    # A member belongs to its class's component if its own count is within the reach of some link.
    reach = links.select(F.col("a").alias("cls"), F.col("b").alias("other"), "most").unionByName(links.select(F.col("b").alias("cls"), F.col("a").alias("other"), "most"))
    owns = classes.select(F.col("cls").alias("other"), F.col("own").alias("own_other"))
    reach = reach.join(owns, "other").select("cls", (F.col("most") - F.col("own_other")).alias("reach"))
    reach = reach.unionByName(met.where("kind = 2").select(F.col("a").alias("cls"), F.col("most").alias("reach"))).groupBy("cls").agg(F.max("reach").alias("reach"))
    inner = classes.select("cls", F.col("sig").alias("head_sig"), (F.expr(f"(length(grams) div 8 * {q - p}) div {p}") - F.col("own")).alias("inner"))
    if count:
        inner = inner.join(_counted(cold, met, classes, rule), "cls")
    else:
        inner = inner.withColumn("n_links", F.lit(None).cast("map<bigint,bigint>"))
    roots = components(links).withColumnsRenamed({"node": "cls"})
    facts = cut(inner.join(reach, "cls", "left").join(roots, "cls", "left"), "facts", tidy=False)
    joined = members.join(facts, "cls")
    joined = joined.where("sig = head_sig or own <= greatest(inner, reach)").select("sig", F.coalesce("root", "cls").alias("root"), F.expr("n_links[own]").alias("n_links"))
    named = cut(joined.join(distinct.select("sig", "least"), "sig"), "rooted", tidy=False)
    first = F.min(F.struct(F.col("least").isNull(), "least", "sig"))
    smallest = cut(named.groupBy("root").agg(F.min("least").alias("component"), first["sig"].alias("first_sig")), "smallest", tidy=False)
    linked = named.join(smallest, "root").select("sig", "component", "n_links", (F.col("sig") == F.col("first_sig")).alias("first"))
    # A table of its own: AQE splits a hot sig only where nothing stands between the shuffles and the join.
    final = cut(distinct.join(linked, "sig", "left").select("sig", "least", F.coalesce("component", "least").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("first", F.lit(True)).alias("first")), "named")
    discard(members, classes, met, cold, facts, named, smallest, distinct)
    return names.join(final, "sig", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        "sig",
        (F.col("sig").isNull() | F.col("first") & F.col("doc_id").eqNullSafe(F.col("least"))).alias("stays"),
    )


def first_of_each(docs: DataFrame, k: int = 5, p: int = 4, q: int = 5) -> DataFrame:
    """The rows of docs that stay if one document of each component does: that of the smallest doc_id (null ones last),
    and of several such rows the first by digest. Rows without words are linked with nothing, so all of them stay."""
    found = cut(_joined(docs, k, p, q, False).select("doc_id", "sig", "stays"), "components")
    again = _repeated(found)
    named = docs.where("doc_id is not null")
    gone = cut(key_join(found.where("not stays and doc_id is not null").select("doc_id"), again, ["doc_id"], "left_anti", rows=FEW), "gone", tidy=False)
    stay = key_join(key_join(named, gone, ["doc_id"], "left_anti", rows=1_000_000), again, ["doc_id"], "left_anti", rows=FEW).select(*docs.columns)
    if again.isEmpty() and found.where("doc_id is null").isEmpty():
        return stay
    # Rows that no doc_id names are told apart by the digest of their set.
    sig = "sig"
    while sig in docs.columns:
        sig += "_"
    rows = _with_sig(_unnamed(docs, again), k, sig, "digest")
    keep = cut(found.where("stays and sig is not null").select(F.col("doc_id").alias("keep_id"), F.col("sig").alias("keep_sig")).distinct(), "keep", tidy=False)
    kept = rows.join(keep, rows["doc_id"].eqNullSafe(keep["keep_id"]) & (rows[sig] == keep["keep_sig"]), "left_semi").dropDuplicates(["doc_id", sig])
    return stay.unionByName(kept.select(*docs.columns)).unionByName(rows.where(F.col(sig).isNull()).select(*docs.columns))
