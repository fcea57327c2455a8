"""Language ID (9): a byte convolutional network trained in numpy.

Bytes (A-Z lower-cased, other ASCII than letters as spaces) are embedded, filters of widths 2, 3 and 4 run over fixed
windows of WINDOW bytes, each filter's largest response in a window is kept, and a softmax layer gives the languages.
A document's distribution is the mean over all its windows, weighed by their bytes. For prediction the embedding and
the filters are folded into one table a filter position, so a response is a sum of four table rows.

Training takes a bounded sample: the LANGUAGES most frequent labels (ties by name), at most PER_LANGUAGE labelled
documents of each, those of least hash of doc_id and text, and at most WINDOWS_EACH windows of each; rows that repeat
count once. Documents whose crc32(doc_id as text) mod 5 is 0 are held out. Only text and lang are learned from; lang,
source and doc_id are never inputs of a prediction.

Defined cases: text that is null or holds no letter gets `und` and score 0, as all texts do if nothing is labelled.
A null doc_id counts as the empty text for the fold. Repeated rows are predicted each. `predict` returns its own
columns only, `keep` those of its input. `keep` rejects texts without a letter, those to whose best language the network
gives less than `least`, and, if the wanted languages are given, those of others. Where nothing is labelled there is no
network; texts with a letter then stay unless languages are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm.cluster import prepare, tidied

UNKNOWN = "und"
WINDOW = 256
#: Bounds of the training sample.
LANGUAGES, PER_LANGUAGE, WINDOWS_EACH = 200, 800, 2
#: Least share of a text's distribution for its best language in `keep`: below it the network knows no language for the text.
LEAST = 0.35
WIDTHS, FILTERS, DIMS = (2, 3, 4), 12, 8
EPOCHS, BATCH, RATE, SEED = 12, 128, 0.01, 7

FOLDED = tb.LOWER.copy()
FOLDED[[b for b in range(128) if not chr(b).isalpha()]] = 0x20


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def windows(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in rows of WINDOW, padded with spaces; each row's text and number of bytes."""
    sizes = np.diff(bounds)
    rows = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), rows)
    serial = np.arange(len(text)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = bounds[:-1][text] + serial * WINDOW
    size = np.minimum(WINDOW, bounds[1:][text] - start)
    out = np.full((len(text), WINDOW), 0x20, np.uint8)
    whole = size == WINDOW
    out[whole] = data[start[whole][:, None] + np.arange(WINDOW)]
    for r in np.flatnonzero(~whole).tolist():
        out[r, : size[r]] = data[start[r] : start[r] + size[r]]
    return FOLDED[out], text, size


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def responses(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - len(self.tables) + 1
        total = self.tables[0][x[:, :n]]
        for j, t in enumerate(self.tables[1:], 1):
            total += t[x[:, j : n + j]]
        return total

    def distribution(self, x: np.ndarray) -> np.ndarray:
        parts = [self.responses(x[i : i + 32]).max(axis=1) for i in range(0, len(x), 32)]
        hidden = np.maximum(np.concatenate(parts) + self.bias, 0) if parts else np.empty((0, len(self.bias)), np.float32)
        logits = hidden @ self.out + self.out_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, languages: list[str]) -> Network:
    """Adam on the cross-entropy; only the positions of the largest responses get gradients."""
    rng = np.random.default_rng(SEED)
    span, f, k = max(WIDTHS), FILTERS * len(WIDTHS), len(languages)
    reach = np.repeat(WIDTHS, FILTERS)
    mask = (np.arange(span)[:, None] < reach).astype(np.float32)[:, None, :]
    p = {
        "embed": rng.normal(0, 0.3, (256, DIMS)).astype(np.float32),
        "filters": rng.normal(0, 0.3, (span, DIMS, f)).astype(np.float32) * mask,
        "bias": np.zeros(f, np.float32),
        "out": rng.normal(0, 0.2, (f, k)).astype(np.float32),
        "out_bias": np.zeros(k, np.float32),
    }
    moments = {n: (np.zeros_like(v), np.zeros_like(v)) for n, v in p.items()}
    step = 0

    def network() -> Network:
        return Network(languages, [p["embed"] @ p["filters"][j] for j in range(span)], p["bias"], p["out"], p["out_bias"])

    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            own = order[i : i + BATCH]
            xb, yb, m = x[own], y[own], network()
            response = m.responses(xb)
            at = response.argmax(axis=1)
            hidden = np.maximum(np.take_along_axis(response, at[:, None, :], 1)[:, 0] + p["bias"], 0)
            logits = hidden @ p["out"] + p["out_bias"]
            e = np.exp(logits - logits.max(axis=1, keepdims=True))
            d = e / e.sum(axis=1, keepdims=True)
            d[np.arange(len(yb)), yb] -= 1
            d /= len(yb)
            dh = (d @ p["out"].T) * (hidden > 0)
            g = {"out": hidden.T @ d, "out_bias": d.sum(0), "bias": dh.sum(0), "embed": np.zeros_like(p["embed"]), "filters": np.zeros_like(p["filters"])}
            for j in range(span):
                seen = np.take_along_axis(xb, at + j, 1)
                g["filters"][j] = np.einsum("bf,bfe->ef", dh, p["embed"][seen]) * mask[j]
                np.add.at(g["embed"], seen, dh[:, :, None] * p["filters"][j].T[None])
            step += 1
            for n, v in p.items():
                a, b = moments[n]
                a *= 0.9
                a += 0.1 * g[n]
                b *= 0.999
                b += 0.001 * g[n] ** 2
                v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return network()


def fit(docs: DataFrame) -> Network | None:
    """A network from the labelled rows of docs that are not held out; None without any."""
    prepare(docs.sparkSession)
    key = F.xxhash64("doc_id", "text")
    labelled = docs.where(~held_out() & F.col("lang").isNotNull()).where(F.col("text").isNotNull())
    counts = labelled.groupBy("lang").agg(F.count("*").alias("rows"), F.approx_count_distinct(key).alias("n")).orderBy(F.desc("rows"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return None
    # A share of each language's hashes that holds its sample with room to spare.
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, (2 * PER_LANGUAGE + 100) / max(1, r["n"])))])
    sample = labelled.where(F.pmod(key, F.lit(1 << 20)) < F.coalesce(share[F.col("lang")], F.lit(0.0)) * (1 << 20)).select(key.alias("key"), "lang", "text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in tb.blocks(batch.column("text")):
                x, text, _ = windows(block.data, block.bounds)
                keys = np.asarray(batch.column("key").slice(block.first, len(block)))
                langs = batch.column("lang").slice(block.first, len(block)).to_pylist()
                first = np.searchsorted(text, np.arange(len(block)))
                count = np.bincount(text, minlength=len(block))
                for i in range(len(block)):
                    if not (x[first[i] : first[i] + count[i]] != 0x20).any():
                        continue
                    # Windows anywhere in the text, by the key.
                    picks = sorted({int((int(keys[i]) + j * 0x9E3779B1) % count[i]) for j in range(WINDOWS_EACH)})
                    n = len(picks)
                    yield pa.RecordBatch.from_arrays([pa.array([int(keys[i])] * n), pa.array([langs[i]] * n), pa.array([x[first[i] + j].tobytes() for j in picks], pa.binary())], ["key", "lang", "window"])

    # A hash has at most WINDOWS_EACH windows of a language, so what is collected is bounded by the share of hashes.
    rows = sorted(tuple(r) for r in sample.mapInArrow(run, "key long, lang string, window binary").distinct().collect())
    kept, seen = [], {}
    for key_, lang, window in rows:
        own = seen.setdefault(lang, set())
        if key_ in own or len(own) < PER_LANGUAGE:
            own.add(key_)
            kept.append((lang, window))
    if not kept:
        return None
    languages = sorted(seen)
    x = np.frombuffer(b"".join(w for _, w in kept), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([languages.index(lang) for lang, _ in kept]), languages)


def _letters(block: tb.Block, i: int) -> bool:
    data = block.data[block.bounds[i] : block.bounds[i + 1]]
    if ((FOLDED[data] != 0x20) & (data < 128)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in data.tobytes().decode())


def _label(column: pa.Array, net: Network | None) -> Iterator[tuple[tb.Block, list[str], list[float]]]:
    for block in tb.blocks(column):
        n = len(block)
        letters = np.array([_letters(block, i) for i in range(n)])
        if net is None:
            yield block, [UNKNOWN] * n, [0.0] * n
            continue
        x, text, size = windows(block.data, block.bounds)
        sums = np.zeros((n, len(net.languages)))
        np.add.at(sums, text, net.distribution(x) * size[:, None])
        mean = sums / np.maximum(np.diff(block.bounds), 1)[:, None]
        best = mean.argmax(axis=1)
        yield block, [net.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], np.where(letters, np.clip(mean.max(axis=1), 0, 1), 0.0).tolist()


def predict(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""
    prepare(docs.sparkSession)
    source = docs.select("doc_id", held_out().alias("held_out"), "text")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, langs, scores in _label(batch.column("text"), net):
                own = batch.slice(block.first, len(block))
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, net: Network | None, least: float = LEAST, languages: list[str] | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text the network gives a language: see the module's docstring."""
    prepare(docs.sparkSession)
    where = docs.columns.index("text")
    wanted = None if languages is None else frozenset(languages)

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if net is None:  # nothing was labelled: that says nothing against these texts
                good = [wanted is None and _letters(block, i) for block in tb.blocks(batch.column(where)) for i in range(len(block))]
            else:
                good = [x != UNKNOWN and score >= least and (wanted is None or x in wanted) for _, langs, scores in _label(batch.column(where), net) for x, score in zip(langs, scores, strict=True)]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
