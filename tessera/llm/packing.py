"""Packing (2): vector bin packing of examples into training sequences.

An example is a vector: tokens, segments (1 each) and loss-bearing tokens. A sequence holds at most max_tokens,
max_segments and max_loss of them. An example over the token limit first gives whole sequences; what remains is placed
by the dot-product heuristic: into the open sequence goes the example that fits and whose vector has the largest dot
product with the room that is left, each dimension weighed by its limit. Examples of equal vectors are alike, so one
step looks at the distinct vectors of the pool, at most max_tokens of them for plain text. Where nothing fits, one
example may be cut to fill the sequence. What is open at a task's end is cut at powers of two, which need no padding.

For instruction data a document may have a prompt, whose tokens come first and bear no loss; a document's end id never
bears any. Plain text without prompts bears loss on every other token, so that its loss limit cannot bind before its
token limit; the limit of segments can, where documents are short.

Each task packs its own examples in pools of POOL; nothing is shuffled, memory is bounded by a pool, and a task that
is run again gives the same sequences. Sequence ids hold the task's number in their upper bits.

Defined cases: null text or prompt is empty, and an empty document has its end id alone. Repeated rows are packed each.
An empty table gives no pieces. Only doc_id, text and the prompt's column of the input are read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.cluster import prepare, tidied

#: Production limits of a sequence.
MAX_TOKENS, MAX_SEGMENTS = 1024, 8
#: Remainders that are placed together.
POOL = 8192
END = 0


@dataclass
class Limits:
    tokens: int = MAX_TOKENS
    segments: int = MAX_SEGMENTS
    loss: int = MAX_TOKENS


class Packer:
    """Places (document, start, length, loss, payload) into numbered sequences; yields pieces as they are placed.

    A cut splits the tokens; loss tokens are counted by loss(document, start, length)."""

    def __init__(self, limits: Limits, loss, base: int = 0):
        self.limits, self.loss, self.next = limits, loss, base
        self.pool: dict[tuple[int, int], list] = defaultdict(list)
        self.held = 0
        self.open_tokens = self.open_segments = self.open_loss = 0
        self.open = False
        self.scale = 1.0 / np.array([limits.tokens, limits.segments, limits.loss], float)

    def add(self, doc, start: int, length: int) -> None:
        self.pool[length, self.loss(doc, start, length)].append((doc, start))
        self.held += 1

    def _close(self) -> None:
        if self.open:
            self.next += 1
        self.open, self.open_tokens, self.open_segments, self.open_loss = False, 0, 0, 0

    def _put(self, doc, start: int, length: int, loss: int):
        piece = (doc, start, length, self.next, self.open_tokens)
        self.open = True
        self.open_tokens += length
        self.open_segments += 1
        self.open_loss += loss
        if self.open_tokens == self.limits.tokens or self.open_segments == self.limits.segments:
            self._close()
        return piece

    def _take(self, vector: tuple[int, int]):
        waiting = self.pool[vector]
        doc, start = waiting.pop()
        self.held -= 1
        if not waiting:
            del self.pool[vector]
        return doc, start

    def place(self, down_to: int = 0) -> Iterator[tuple]:
        """Pieces placed until at most so many examples wait."""
        vectors = None
        while self.held > down_to:
            if vectors is None or len(vectors) != len(self.pool):
                vectors = np.array(sorted(self.pool), np.int64)
            room = np.array([self.limits.tokens - self.open_tokens, self.limits.segments - self.open_segments, self.limits.loss - self.open_loss], float)
            fits = (vectors[:, 0] <= room[0]) & (vectors[:, 1] <= room[2])
            if fits.any():
                gain = vectors[:, 0] * (room[0] * self.scale[0] ** 2) + room[1] * self.scale[1] ** 2 + vectors[:, 1] * (room[2] * self.scale[2] ** 2)
                best = tuple(vectors[int(np.where(fits, gain, -1.0).argmax())].tolist())
                doc, start = self._take(best)
                yield self._put(doc, start, best[0], best[1])
                continue
            whole = int(room[0])
            vector = tuple(vectors[int(vectors[:, 0].argmax())].tolist())
            doc, start = self.pool[vector][-1]
            while whole and self.loss(doc, start, whole) > room[2]:
                whole -= 1
            if whole:
                self._take(vector)
                yield self._put(doc, start, whole, self.loss(doc, start, whole))
                self.add(doc, start + whole, vector[0] - whole)
                vectors = None
            if self.open:  # nothing more fits, by its loss tokens if not by its tokens
                self._close()

    def finish(self, pieces: list[tuple]) -> Iterator[tuple]:
        """The pieces of the sequence still open, cut so that every sequence they give has a power of two of tokens."""
        total = sum(p[2] for p in pieces)
        bit, offset = 1 << max(0, total.bit_length() - 1), 0
        for doc, start, length, _, _ in pieces:
            while length:
                if not total & bit:
                    bit >>= 1
                    continue
                part = min(length, bit - offset)
                yield doc, start, part, self.next, offset
                start, length, offset = start + part, length - part, offset + part
                if offset == bit:
                    self.next, offset, bit = self.next + 1, 0, bit >> 1


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(docs: DataFrame, name: str = tokens.BPE, limits: Limits | None = None, with_ids: bool = False, prompt: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids] of every piece.

    A document is the tokenizer's ids of its prompt (the column of that name, if given), of its text, and the id END;
    only the text's ids bear loss."""
    prepare(docs.sparkSession)
    limits = limits or Limits()
    source = docs.select("doc_id", "text", *([F.col(prompt).alias("_prompt")] if prompt else []))
    kind = source.schema["doc_id"].dataType.simpleString()

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[object, np.ndarray, int]] = {}  # of each waiting document: its id, its last ids, where they begin
        sizes: dict[int, int] = {}
        asked: dict[int, int] = {}  # tokens of a document's prompt
        left: dict[int, int] = {}
        out: list[tuple] = []
        last: list[tuple] = []  # pieces of the open sequence, which may yet be cut
        serial, doc_type = 0, None
        base = TaskContext.get().partitionId() << 40
        full_number = base + (1 << 39)
        step = min(limits.tokens, limits.loss)

        def loss(d: int, start: int, n: int) -> int:
            return max(0, min(start + n, sizes[d] - 1) - max(start, asked.get(d, 0)))

        packer = Packer(limits, loss, base)

        def emit(piece: tuple) -> None:
            d, start, n, sequence, offset = piece
            doc_id, ids, first = held[d]
            part = ids[start - first : start - first + n]
            row = (doc_id, start, n, zlib.crc32(part.astype("<u4").tobytes()), sizes[d], sequence, offset, packer.loss(d, start, n))
            out.append((*row, part.tolist()) if with_ids else row)
            left[d] -= n
            if not left[d]:
                del held[d], sizes[d], left[d]
                asked.pop(d, None)

        def placed(pieces: Iterator[tuple]) -> None:
            for piece in pieces:
                if last and last[0][3] != piece[3]:
                    for x in last:
                        emit(x)
                    last.clear()
                last.append(piece)

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                types = [doc_type, *[pa.int64()] * 7, *[pa.list_(pa.int64())] * with_ids]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", *["ids"] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out.clear()

        for batch in batches:
            doc_type = batch.column("doc_id").type
            heads = [x for block, ids, at in tokens.encode(batch.column("_prompt"), name) for x in np.split(ids, at[1:-1])] if prompt else None
            for block, ids, at in tokens.encode(batch.column("text"), name):
                for i, doc_id in enumerate(batch.column("doc_id").slice(block.first, len(block)).to_pylist()):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(END))
                    d, serial = serial, serial + 1
                    if heads is not None and len(head := heads[block.first + i]):
                        own, asked[d] = np.concatenate([head, own]), len(head)
                    sizes[d] = left[d] = len(own)
                    full = len(own) // step * step
                    held[d] = (doc_id, own, 0)
                    for start in range(0, full, step):
                        emit((d, start, step, full_number, 0))
                        full_number += 1
                    if full < len(own):
                        held[d] = (doc_id, own[full:].copy(), full)
                        packer.add(d, full, len(own) - full)
                placed(packer.place(POOL))
                yield from flush()
        placed(packer.place())
        if packer.open:
            for x in list(packer.finish(last)):
                emit(x)
        else:
            for x in last:
                emit(x)
        yield from flush()

    return source.mapInArrow(run, f"doc_id {kind}, {PIECES}" + ", ids array<long>" * with_ids)
