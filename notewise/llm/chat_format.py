r"""Chat formatting at token level.

A conversation becomes ``<|im_start|>role\ntext<|im_end|>\n`` per turn. The signs that mark turns
are ids of their own, next to the vocabulary: role and text of a turn are encoded separately
as ordinary text and the reserved ids are spliced between them, so no text can produce one. A
control string occurring in content is escaped as well (a backslash after its ``<``; where
there are some already, one more), so the decoded output is unambiguous too and content is
restored exactly. In roles, newlines and backslashes are escaped, as a newline ends the role.

Offsets of segments in the output are prefix sums of their lengths, and the loss mask is the
prefix sum of +1 at the start and -1 at the end of every trained text: it covers the texts of
the trained roles and nothing else.

Scale: turns are encoded where they are read, then dealt out by conversation and sorted by turn;
assembly reads the sorted rows as a stream. A conversation is one row up to ``PIECE_TOKENS``
tokens and goes on in further pieces, cut between turns, so one of any length (even one that
holds a third of all rows) is assembled and read back in bounded memory: a piece and a turn.

Turns are ordered by turn (null last), then role, then the token ids of the text. A null text
or role is empty. Rows without a conv_id belong to no common conversation: each is one of its
own, with a null conv_id. Rows that repeat are separate turns. Empty tables give empty
results; extra columns are ignored. White space runs over 4,096 characters are encoded in
stretches, as the tokenizer cannot take them whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = ("assistant",)
PIECE_TOKENS = 1 << 20
FORMATTED = "conv_id {}, piece int, n_turns int, ids array<int>, mask array<boolean>"
_CONTROL = re.compile(r"<(\\*)\|(im_start|im_end)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|(im_start|im_end)\|>")
_BLANKS = re.compile(r"\s{4096}")


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|\2|>", text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


class Codec:
    """A byte-level BPE vocabulary (a file of base64 token and rank) and the reserved ids after it."""

    def __init__(self, path: str, pattern: str, reserved: tuple[str, ...] = (START, END)):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bpe = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        first = max(ranks.values()) + 2  # the id after the vocabulary is left to its end-of-text sign
        self.reserved = {name: first + k for k, name in enumerate(reserved)}
        self.start, self.end = self.reserved[START], self.reserved[END]
        self.newline = ranks[b"\n"]
        self.dtype = np.dtype(">u2" if first + len(reserved) <= 1 << 16 else ">u4")

    def encode(self, text: str) -> np.ndarray:
        ids, at = [], 0
        for blank in _BLANKS.finditer(text):
            ids += self.bpe.encode_ordinary(text[at:blank.end()])
            at = blank.end()
        return np.array(ids + self.bpe.encode_ordinary(text[at:]), np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.bpe.decode_bytes(ids.tolist()).decode("utf-8")


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def splice(turns: list[tuple[np.ndarray, np.ndarray, bool]], codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """ids and loss mask of turns (role ids, text ids, trained)."""
    start, newline, end = (np.array([i], np.int32) for i in (codec.start, codec.newline, codec.end))
    segments = [s for role, text, _ in turns for s in (start, role, newline, text, end, newline)]
    offsets = np.cumsum([0, *map(len, segments)])
    step = np.zeros(offsets[-1] + 1, np.int32)
    for k, (_, _, trained) in enumerate(turns):
        if trained:
            step[offsets[6 * k + 3]] += 1
            step[offsets[6 * k + 4]] -= 1
    return np.concatenate(segments), np.cumsum(step)[:-1] > 0


def turns_of(ids: np.ndarray, mask: np.ndarray, codec: Codec) -> Iterator[tuple[str, str, list[str]]]:
    """(role, text, texts under the mask), read from ids and mask alone."""
    ends = np.flatnonzero(ids == codec.end)
    for a, b in zip(np.flatnonzero(ids == codec.start).tolist(), ends.tolist(), strict=True):
        head = a + 1 + int(np.argmax(ids[a + 1:b] == codec.newline))
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask[a:b + 1].astype(np.int8), [0]])))
        under = [unescape(codec.decode(ids[a + lo:a + hi])) for lo, hi in edges.reshape(-1, 2).tolist()]
        yield unescape_role(codec.decode(ids[a + 1:head])), unescape(codec.decode(ids[head + 1:b])), under


def formatted_text(ids: np.ndarray, codec: Codec) -> str:
    """The decoded output, reserved ids as their names."""
    names, out, at = {i: name for name, i in codec.reserved.items()}, [], 0
    for k in np.flatnonzero(np.isin(ids, list(names))).tolist():
        out += [codec.decode(ids[at:k]), names[int(ids[k])]]
        at = k + 1
    return "".join(out) + codec.decode(ids[at:])


def format_conversations(turns: DataFrame, path: str, pattern: str, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, piece, n_turns, ids, mask: the conversations of ``turns`` (conv_id, turn, role, text)."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def encode(batches):
        own = codec(path, pattern)
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            pack = lambda texts: pa.array([own.encode(t).astype(own.dtype).tobytes() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pack(map(escape_role, roles)),
                 pack(escape(t or "") for t in batch.column("text").to_pylist())], names=["conv_id", "turn", "role", "head", "body"])

    encoded = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").mapInArrow(
        encode, f"conv_id {kind}, turn long, role string, head binary, body binary")
    own_place = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "body")).otherwise(F.xxhash64("conv_id"))
    dealt = encoded.repartition(own_place).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "body")

    def assemble(batches):
        own = codec(path, pattern)
        now, piece, held, size = None, 0, [], 0

        def row():
            ids, mask = splice(held, own)
            return pa.RecordBatch.from_arrays(
                [pa.array([now], ids_type), pa.array([piece], pa.int32()), pa.array([len(held)], pa.int32()),
                 pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pa.array(ids, pa.int32())),
                 pa.ListArray.from_arrays(pa.array([0, len(mask)], pa.int32()), pa.array(mask, pa.bool_()))],
                names=["conv_id", "piece", "n_turns", "ids", "mask"])

        for batch in batches:
            ids_type = batch.column("conv_id").type
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "role", "head", "body"))
            done = []
            for conv, role, head, body in zip(*columns, strict=True):
                other = conv is None or conv != now
                if held and (other or size >= PIECE_TOKENS):
                    done.append(row())
                    piece, held, size = piece + 1, [], 0
                if other:
                    now, piece = conv, 0
                turn = (*(np.frombuffer(x, own.dtype).astype(np.int32) for x in (head, body)), role in trained)
                held.append(turn)
                size += len(turn[0]) + len(turn[1])
            yield from _merged(done)
        if held:
            yield row()

    return dealt.mapInArrow(assemble, FORMATTED.format(kind))


def _merged(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about ``PIECE_TOKENS`` tokens."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row.column("ids").values)
        if size >= PIECE_TOKENS:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def read_back(formatted: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of what ``format_conversations`` returned, from its ids and masks: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Reads the rows in the order in which they were made (pieces of a conversation follow
    each other in one partition), so it adds no shuffle.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def digest(batches):
        own = codec(path, pattern)
        now = None

        def rows(found, ids_type):
            conv, n, turns, chars, loss, size = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array(conv, ids_type), pa.array(n, pa.int64()), pa.array([h.hexdigest() for h in turns]),
                 pa.array(chars, pa.int64()), pa.array([h.hexdigest() for h in loss]), pa.array(size, pa.int64())],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            ids_type, done = batch.column("conv_id").type, []
            ids, mask = batch.column("ids"), batch.column("mask")
            for k, (conv, piece) in enumerate(zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True)):
                if piece == 0:
                    done += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                found = ids[k].values.to_numpy()
                for role, text, under in turns_of(found, mask[k].values.to_numpy(zero_copy_only=False), own):
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                    for part in under:
                        now[3] += len(part)
                        now[4].update(part.encode())
                now[5] += len(formatted_text(found, own))
            if done:
                yield rows(done, ids_type)
        if now:
            yield rows([now], ids_type)

    return formatted.mapInArrow(digest, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
                                        "loss_sha256 string, formatted_chars long")
