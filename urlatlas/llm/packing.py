"""Packing of tokenised documents into sequences by vector bin packing: a sequence has limits on tokens, segments and
loss-bearing tokens at once, and the open sequence takes the piece whose demands have the largest dot product with what is
left of the limits.

A document is a prompt, which bears no loss, and the rest, which does. Where no waiting piece fits the open sequence, one is
cut to fill it; a sequence that still is short is cut at powers of two, which need no padding. Each partition packs its own
rows: no shuffle, and nothing waits for all rows. At most `window` pieces of at most a sequence's length wait for a place.

Cases: null or empty text is the end token alone; repeated rows and ties are packed each, the first one first; very long texts
are cut; extra columns are not looked at; an empty table gives no pieces. `sequence_id` is unique over the table, not dense.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .byte_bpe import RUN_BYTES, TextEncoder, merges_of_tokenizer
from .common import joined, small_batches, tidy

#: Of a piece that is placed already: it fits nowhere.
_GONE = 1 << 40


@dataclass(frozen=True)
class Limits:
    """Of a sequence. `window`: pieces that wait for a place at most."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 1792
    window: int = 1024


class Packer:
    """Places documents given as (key, ids, loss-bearing ids, which are the last ones), ids as 4 bytes each; yields pieces as
    (key, start, ids, sequence, offset). `by_size`: the largest piece that fits is taken, whatever the other limits say."""

    def __init__(self, limits: Limits, first_sequence: int = 0, by_size: bool = False):
        self.limits, self.next, self.by_size = limits, first_sequence, by_size
        self.waiting: list[tuple] = []  # (key, start, ids, how many of them come before the loss-bearing ones)

    def add(self, key, ids: bytes, loss_tokens: int) -> Iterator[tuple]:
        limits, start, tokens = self.limits, 0, len(ids) // 4
        prompt = tokens - loss_tokens
        while start < tokens:
            length = min(tokens - start, limits.tokens, max(0, prompt - start) + limits.loss_tokens)
            part = ids[4 * start : 4 * (start + length)]
            if length == limits.tokens:  # a whole sequence
                yield key, start, part, self._number(), 0
            else:
                self.waiting.append((key, start, part, min(length, max(0, prompt - start))))
                if len(self.waiting) >= limits.window:
                    yield from self._place(limits.window // 2)
            start += length

    def finish(self) -> Iterator[tuple]:
        yield from self._place(0)

    def _number(self) -> int:
        self.next += 1
        return self.next - 1

    def _place(self, keep: int) -> Iterator[tuple]:
        """Fills sequences until at most `keep` pieces wait."""
        limits, waiting = self.limits, self.waiting
        length = np.array([len(ids) // 4 for _, _, ids, _ in waiting], np.int64)
        prompt = np.array([n for *_, n in waiting], np.int64)
        loss, left = length - prompt, len(waiting)
        while left > keep:
            tokens, segments, bearing, content = limits.tokens, limits.segments, limits.loss_tokens, []
            while left and tokens and segments:
                # demands and what is left, both as shares of the limits; every piece is one segment
                weights = tokens / limits.tokens**2, segments / limits.segments**2, 0.0 if self.by_size else bearing / limits.loss_tokens**2
                worth = np.where((length <= tokens) & (loss <= bearing), length * weights[0] + loss * weights[2] + weights[1], -1)
                best = int(worth.argmax())
                n = int(length[best])
                if worth[best] < 0:  # none fits: one is cut, and its rest waits on
                    room = np.minimum(np.minimum(length, tokens), prompt + bearing)
                    worth = np.where(room > 0, room * weights[0] + np.maximum(0, room - prompt) * weights[2], -1)
                    best = int(worth.argmax())
                    if worth[best] < 0:
                        break
                    n = int(room[best])
                key, start, ids, before = waiting[best]
                content.append((key, start, ids[: 4 * n]))
                tokens, segments, bearing = tokens - n, segments - 1, bearing - max(0, n - before)
                if n == length[best]:
                    length[best], prompt[best], left = _GONE, -_GONE, left - 1
                else:
                    waiting[best] = key, start + n, ids[4 * n :], max(0, before - n)
                    length[best] -= n
                    prompt[best] = max(0, before - n)
                    loss[best] = length[best] - prompt[best]
            yield from self._emit(content)
        self.waiting = [x for x, n in zip(waiting, length, strict=True) if n < _GONE]

    def _emit(self, content: list[tuple]) -> Iterator[tuple]:
        """One sequence; a short one is cut at powers of two, the largest first."""
        total, at = sum(len(ids) // 4 for *_, ids in content), 0
        number, room = self._number(), total if total == self.limits.tokens else 1 << (total.bit_length() - 1)
        for key, start, ids in content:
            while ids:
                if at == room:
                    total -= room
                    number, room, at = self._number(), 1 << (total.bit_length() - 1), 0
                n = min(len(ids) // 4, room - at)
                yield key, start, ids[: 4 * n], number, at
                start, ids, at = start + n, ids[4 * n :], at + n


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer_path: str, pattern: str, end_id: int = 1, limits: Limits = Limits(), prompt_share: float = 0.25) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. The first `prompt_share` of a
    document's ids, rounded down, is its prompt."""

    def run(batches):
        encoder, end = TextEncoder(merges_of_tokenizer(tokenizer_path), pattern), end_id.to_bytes(4, "little")
        packer = Packer(limits, TaskContext.get().partitionId() << 33)
        names = ["doc_id", *[x.split()[0] for x in PIECES.split(", ")]]

        def batch(placed, kind):
            columns = [[] for _ in names]
            for (doc_id, tokens), start, ids, number, offset in placed:
                row = doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, number, offset
                for column, x in zip(columns, row, strict=True):
                    column.append(x)
            return pa.RecordBatch.from_arrays([pa.array(c, kind if k == 0 else pa.int64()) for k, c in enumerate(columns)], names)

        def place(doc_ids, ids, starts):
            for doc_id, lo, hi in zip(doc_ids.to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                whole = ids[lo:hi].tobytes() + end
                tokens = len(whole) // 4
                yield from packer.add((doc_id, tokens), whole, tokens - int(prompt_share * tokens))

        kind = None
        for b in joined(batches, RUN_BYTES):
            kind = b.column("doc_id").type
            ids, starts = encoder.texts(b.column("text"))
            for lo in range(0, b.num_rows, 2000):
                part = b.column("doc_id").slice(lo, 2000)
                yield batch(place(part, ids, starts[lo : lo + len(part) + 1]), kind)
        if kind is not None:
            yield batch(packer.finish(), kind)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")
