"""Chat formatting (5): token-level assembly of conversations.

A turn is `### {Role}: {text} </turn>` and a line feed. The three marks are reserved ids that no text can give; role
and text are encoded as segments of their own and the ids are spliced. The loss mask comes from prefix sums: +1 where
an assistant's text begins, -1 where it ends, counted over the spliced ids. In the readable form the marks are their
strings, so strings in roles and texts that would read as a mark, and backslashes, are escaped reversibly.

`assemble` gives a row for each turn with its place in the conversation, so no row grows with a conversation of very
many turns; ordered by `place` and joined, the rows are the conversation. `read_back` reads roles, texts and what bears
loss from the ids and the mask alone, and streams a conversation in that order: its digests are of one long text, so
one task reads all of a conversation, in memory that a batch of turns bounds.

Defined cases: null role or text is empty. Turns go by turn (null first), then role, then text; repeated rows are
turns of their own. Rows of null conv_id are one conversation. A conversation without an assistant has no loss: 0
characters and the digest of ''. Only conv_id, turn, role and text of the input are read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import textblocks as tb
from tessera.llm import tokens
from tessera.llm.cluster import partitions, prepare, tidied

# The template's marks.
OPEN, SPLIT, CLOSE = "### ", ": ", " </turn>\n"
LEARNED_ROLE = "assistant"
# Roles that are shown by a name; a role that is itself such a name is shown after a backslash.
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
NAMED = {name: role for role, name in SHOWN.items()}

#: Reserved ids follow the tokenizer's own 50,257.
OPEN_ID, SPLIT_ID, CLOSE_ID = 50257, 50258, 50259

_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:\\.|[^\\:])*): ((?:\\.|[^\\#<]|#(?!##)|<(?!/turn>))*) </turn>\n", re.S)


def escape(text: str, control: re.Pattern = _CONTROL) -> str:
    return control.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def _encoded(texts: list[str], name: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and where each text's begin."""
    ids, at, n = [np.empty(0, np.uint32)], [np.zeros(1, np.int64)], 0
    for _, own, bounds in tokens.encode(pa.array(texts, pa.large_string()), name):
        ids.append(own)
        at.append(bounds[1:] + n)
        n += len(own)
    return np.concatenate(ids), np.concatenate(at)


def assemble(conversations: DataFrame, name: str = tokens.BPE) -> DataFrame:
    """conv_id, place (from 0), first_token (of the turn in its conversation), ids, loss_mask, formatted."""
    prepare(conversations.sparkSession)
    source = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in source.schema}

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            shown_of = {r: escape(SHOWN.get(r, r), _ROLE_CONTROL) if r in SHOWN or r not in NAMED else "\\" + r for r in set(roles)}
            shown = [escape(t) if "\\" in t or "###" in t or "</turn>" in t else t for t in batch.column("text").to_pylist()]
            names = sorted(shown_of)
            role_ids, role_at = _encoded([shown_of[r] for r in names], name)
            which = np.array([names.index(r) for r in roles] if len(names) < 50 else list(map({r: i for i, r in enumerate(names)}.get, roles)), np.int64)
            text_ids, text_at = _encoded(shown, name)
            r, t = np.diff(role_at)[which], np.diff(text_at)
            ends = np.cumsum(r + t + 3)
            first = ends - (r + t + 3)
            ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
            ids[first], ids[first + 1 + r], ids[ends - 1] = OPEN_ID, SPLIT_ID, CLOSE_ID
            ids[tb.ragged(first + 1, r)] = role_ids[tb.ragged(role_at[which], r)]
            ids[tb.ragged(first + r + 2, t)] = text_ids
            edges = np.zeros(len(ids) + 1, np.int32)
            learned = np.array([x == LEARNED_ROLE for x in roles], bool)
            np.add.at(edges, (first + r + 2)[learned], 1)
            np.add.at(edges, (ends - 1)[learned], -1)
            offsets = pa.array(np.concatenate(([0], ends)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in ("conv_id", "turn", "role", "text")),
                    pa.ListArray.from_arrays(offsets, pa.array(ids)),
                    pa.ListArray.from_arrays(offsets, pa.array(np.cumsum(edges[:-1]) > 0)),
                    pa.array([OPEN + shown_of[x] + SPLIT + y + CLOSE for x, y in zip(roles, shown, strict=True)], pa.string()),
                ],
                ["conv_id", "turn", "role", "text", "ids", "loss_mask", "formatted"],
            )

    turns = source.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in kinds) + ", ids array<int>, loss_mask array<boolean>, formatted string")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id",
        (F.row_number().over(order) - 1).cast("long").alias("place"),
        (F.sum(F.size("ids").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.size("ids")).alias("first_token"),
        "ids",
        "loss_mask",
        "formatted",
    )


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation or turn."""
    out, position = [], 0
    while position < len(formatted):
        m = _TURN.match(formatted, position)
        if m is None:
            raise ValueError(f"no turn at {position}")
        out.append((_role(m[1]), unescape(m[2])))
        position = m.end()
    return out


def _role(shown: str) -> str:
    """The role that is shown so."""
    if shown in NAMED:
        return NAMED[shown]
    return shown[1:] if shown.startswith("\\") and shown[1:] in NAMED else unescape(shown)


def read_back(assembled: DataFrame, name: str = tokens.BPE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, from ids and loss mask."""
    spark = assembled.sparkSession
    kind = assembled.schema["conv_id"].dataType.simpleString()
    dealt = assembled.select("conv_id", "place", "ids", "loss_mask").repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "place")

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.coder(name)
        now = None  # conv_id and what has been read of it
        for batch in batches:
            out = []
            if not batch.num_rows:
                continue
            ids = batch.column("ids").flatten().to_numpy(zero_copy_only=False)
            mask = batch.column("loss_mask").flatten().to_numpy(zero_copy_only=False).astype(bool)
            sizes = pc.list_value_length(batch.column("ids")).to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(sizes)
            opens, splits, closes = (np.flatnonzero(ids == x) for x in (OPEN_ID, SPLIT_ID, CLOSE_ID))
            if not (len(opens) == len(splits) == len(closes) == batch.num_rows and (opens == ends - sizes).all() and (closes == ends - 1).all() and ((opens < splits) & (splits < closes)).all()):
                raise ValueError("the reserved ids do not part the turns")
            # Segments in turn: a role, a text, a role, ...
            plain = ids[(ids < OPEN_ID) | (ids > CLOSE_ID)]
            bounds = np.concatenate(([0], np.cumsum(np.stack([splits - opens - 1, closes - splits - 1], 1).ravel())))
            segments = coder.texts(plain, bounds)
            learned = coder.texts(ids[mask], np.concatenate(([0], np.cumsum(mask)[ends - 1])))
            for i, (conv, n) in enumerate(zip(batch.column("conv_id").to_pylist(), sizes.tolist(), strict=True)):
                if now is None or now[0] != conv:
                    if now is not None:
                        out.append(now)
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                shown_role, shown = segments[2 * i].decode(), segments[2 * i + 1].decode()
                text = unescape(shown) if "\\" in shown else shown
                now[1] += 1
                now[2].update(f"{_role(shown_role)}\n{text}\n".encode())
                if learned[i]:
                    own = learned[i].decode()
                    own = unescape(own) if "\\" in own else own
                    now[3] += len(own)
                    now[4].update(own.encode())
                now[5] += len(OPEN) + len(shown_role) + len(SPLIT) + len(shown) + len(CLOSE)
                now[6] += n
            yield result(out)
        if now is not None:
            yield result([now])

    def result(rows: list) -> pa.RecordBatch:
        columns = list(zip(*[(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5], r[6]) for r in rows], strict=True)) or [[]] * 7
        types = [to_arrow_type(assembled_type), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens"])

    from pyspark.sql.pandas.types import to_arrow_type

    assembled_type = assembled.schema["conv_id"].dataType
    return dealt.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long")
