"""Token ids of many whole texts at once, exactly as a public tokenizer gives them.

For the byte-level BPE in byte_bpe_50k.json, no token reaches over the start of a run of white space, so a text is
cut there into pieces whose ids do not depend on each other. A block's distinct pieces are found by a 64-bit hash, which
is xxh3 for long ones; only those that the worker does not remember are encoded, as one string, and a text's ids are
gathered from the pieces'. The
rank file of the same vocabulary does that encoding (tests hold it against the library); a text that holds a string
of a special token goes to the library itself, which has its own rules for these. Other tokenizers (.json by
tokenizers, .model by sentencepiece) encode text by text.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import textblocks as tb

BPE = "byte_bpe_50k.json"
#: Pieces and bytes of pieces that a worker remembers; beyond either it forgets all and begins anew.
REMEMBERED, REMEMBERED_BYTES = 400_000, 16 << 20
#: Bytes of text that are encoded at once, unless a single text is longer.
BLOCK_BYTES = 1 << 19


def tokenizer_path(name: str = BPE) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


@lru_cache
def version(name: str = BPE) -> str:
    """Digest of the tokenizer's file and library: counts under another version are not reused."""
    import importlib.metadata

    path = tokenizer_path(name)
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"{library} {importlib.metadata.version(library)}".encode()).hexdigest()


class Library:
    """Any tokenizer of the two libraries, text by text. It is loaded when a text first needs it."""

    def __init__(self, path: str):
        self.path = path
        if path.endswith(".json"):
            with open(path, "rb") as f:
                added = json.load(f).get("added_tokens") or []
            self.special_ids = {t["id"]: t["content"].encode() for t in added}
        else:
            self.special_ids = {}
        self.special = sorted(self.special_ids.values())

    @cached_property
    def model(self):
        if self.path.endswith(".json"):
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(self.path)
            model.no_truncation()
            model.no_padding()
            return model
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=self.path)

    def one(self, text: str) -> list[int]:
        if self.path.endswith(".json"):
            return self.model.encode(text, add_special_tokens=False).ids
        return self.model.encode(text, num_threads=1)

    def decode(self, ids: list[int]) -> str:
        return self.model.decode(ids, skip_special_tokens=False) if self.path.endswith(".json") else self.model.decode(ids)

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The bytes of the segments ids[bounds[i] : bounds[i + 1]]."""
        return [self.decode(ids[a:b].tolist()).encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def block(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(self.one(block.text(i).decode()), np.uint32) for i in range(len(block))]
        return np.concatenate([np.empty(0, np.uint32), *ids]), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)


_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(9, 14)]] = True


class Pieces(Library):
    """The byte-level BPE, by remembered pieces."""

    def __init__(self, path: str):
        super().__init__(path)
        import public_tokenizers
        import tiktoken

        with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        every = {rank: token for token, rank in ranks.items()} | self.special_ids
        self.width = np.zeros(max(every) + 1, np.int64)
        for rank, token in every.items():
            self.width[rank] = len(token)
        self.first = np.cumsum(self.width) - self.width
        self.bytes = np.frombuffer(b"".join(every[rank] for rank in sorted(every)), np.uint8)
        self.forget()

    def texts(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        width = self.width[ids]
        data = self.bytes[tb.ragged(self.first[ids], width)].tobytes()
        edges = np.concatenate(([0], np.cumsum(width)))[bounds].tolist()
        return [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]

    def forget(self) -> None:
        none = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        #: Keys in order, where each piece's ids begin, and how many there are: of long known pieces, and of recent ones.
        self.old, self.recent = none, none
        self.ids, self.learned = np.empty(0, np.uint32), 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each piece is remembered, where its ids begin, and how many there are."""
        known, at, size = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, a, n in (self.old, self.recent):
            if len(k):
                slot = np.searchsorted(k, keys)
                slot[slot == len(k)] = 0
                hit = k[slot] == keys
                known |= hit
                at[hit], size[hit] = a[slot[hit]], n[slot[hit]]
        return known, at, size

    @staticmethod
    def merged(one: tuple, two: tuple) -> tuple:
        order = np.argsort(np.concatenate([one[0], two[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(one, two, strict=True))

    @staticmethod
    def cuts(block: tb.Block) -> np.ndarray:
        """Where pieces begin: at each text, and at white space in ASCII after a character that is none."""
        data, bounds = block.data, block.bounds
        n = len(data)
        ascii_white = _WHITE[data]
        blank = ascii_white.copy()
        wide = np.flatnonzero((data == 0xC2) | (data == 0xE1) | (data == 0xE2) | (data == 0xE3))
        wide = wide[wide < n - 2]
        # Characters that may be white space outside ASCII; to take more for it only makes pieces longer.
        blank[wide[(data[wide] == 0xC2) & ((data[wide + 1] == 0x85) | (data[wide + 1] == 0xA0))] + 1] = True
        three = wide[((data[wide] == 0xE1) & (data[wide + 1] == 0x9A)) | ((data[wide] == 0xE2) & ((data[wide + 1] == 0x80) | (data[wide + 1] == 0x81))) | ((data[wide] == 0xE3) & (data[wide + 1] == 0x80))]
        blank[three + 2] = True
        control = (data >= 0x1C) & (data <= 0x1F)
        begins = ascii_white
        begins[1:] &= ~(blank | control)[:-1]
        begins[:1] = True
        starts = bounds[:-1][np.diff(bounds) > 0]
        begins[starts] = True
        return np.flatnonzero(begins)

    def block(self, block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
        n = len(block.data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(block.bounds), np.int64)
        if any(x in block.data.tobytes() for x in self.special):
            return super().block(block)
        starts = self.cuts(block)
        ends = np.append(starts[1:], n)
        keys, first, which = np.unique(tb.span_hashes(block.data, starts, ends), return_index=True, return_inverse=True)
        if len(self.old[0]) + len(self.recent[0]) > REMEMBERED or self.learned > REMEMBERED_BYTES:
            self.forget()
        known, at, size = self.find(keys)
        if not known.all():
            new = ~known
            self.learn(keys[new], block.data, starts[first[new]], ends[first[new]])
            _, at, size = self.find(keys)
        at, size = at[which], size[which]
        ids = self.ids[tb.ragged(at, size)]
        ends_at = np.concatenate(([0], np.cumsum(size)))
        return ids, ends_at[np.searchsorted(starts, block.bounds)]

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        # A piece that does not begin with white space would join the one before it; a line feed parts them.
        sizes = ends - starts
        bare = ~_WHITE[data[starts]]
        blank_end = _WHITE[data[ends - 1]]
        plain = ~bare & ~blank_end
        where, count = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        self.learned += int(sizes.sum())
        base = len(self.ids)
        fresh = np.empty(0, np.uint32)
        if plain.any():
            joined = data[tb.ragged(starts[plain], sizes[plain])].tobytes().decode()
            fresh = np.array(self.coder.encode_ordinary(joined), np.uint32)
            bytes_at = np.concatenate(([0], np.cumsum(self.width[fresh])))
            edges = np.concatenate(([0], np.cumsum(sizes[plain])))
            tokens_at = np.searchsorted(bytes_at, edges)
            where[plain], count[plain] = base + tokens_at[:-1], np.diff(tokens_at)
        base += len(fresh)
        rest = []
        for k in np.flatnonzero(~plain).tolist():
            ids = self.coder.encode_ordinary(data[starts[k] : ends[k]].tobytes().decode())
            where[k], count[k] = base, len(ids)
            base += len(ids)
            rest += ids
        self.ids = np.concatenate([self.ids, fresh, np.array(rest, np.uint32)])
        self.recent = self.merged(self.recent, (keys, where, count))
        if len(self.recent[0]) > max(20_000, len(self.old[0]) // 4):
            self.old, self.recent = self.merged(self.old, self.recent), tuple(x[:0] for x in self.old)


@lru_cache
def coder(name: str = BPE) -> Library:
    """The worker's own tokenizer; .block(block) gives all ids and where each text's begin."""
    path = tokenizer_path(name)
    return (Pieces if os.path.basename(path) == BPE and os.path.exists(path.removesuffix(".json") + ".tiktoken") else Library)(path)


def encode(column: pa.Array, name: str = BPE):
    """For each block of the column: the block, its ids and where each text's ids begin (one more than texts)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    for block in tb.blocks(pc.fill_null(column, ""), BLOCK_BYTES):
        yield block, *coder(name).block(block)
