"""Packing: examples placed into sequences under several limits at once.

A sequence has a limit on tokens, on segments (pieces) and on loss-bearing
tokens.  Pieces are chosen by the dot product of what they need with what the
sequence has left, both in shares of the limits.  Examples may be cut anywhere.
"""

from __future__ import annotations

import gc
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkgas.llm.common import bounded_batches, texts
from sparkgas.llm.tokens import IdCache, default_file, read_file

PIECES = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint, loss_tokens bigint"
)


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold.  ``waiting`` bounds the examples that a task keeps back for a better fit."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    waiting: int = 48

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.waiting) < 1:
            raise ValueError("limits must be 1 or more")


@dataclass
class Part:
    """What is still to be placed of an example: its ids from ``start`` on."""

    doc_id: int | None
    ids: bytes
    start: int
    loss_from: int

    @property
    def size(self) -> int:
        return len(self.ids) // 4 - self.start

    def loss(self, length: int) -> int:
        """Loss-bearing tokens among the next ``length``: those at ``loss_from`` or behind it."""
        return max(0, self.start + length - max(self.start, self.loss_from))

    def longest(self, tokens: int, loss: int) -> int:
        """The most tokens that can be cut off in front within both limits."""
        free = max(0, self.loss_from - self.start)
        return min(self.size, tokens, free + loss)


class Packer:
    """The sequences of one task.  Its memory is bounded by ``Limits.waiting`` remainders below the token limit."""

    def __init__(self, limits: Limits, first_id: int):
        self.limits, self.next_id = limits, first_id
        self.waiting: list[Part] = []
        self.rows: list[tuple] = []
        self.held = 0

    def add(self, part: Part) -> None:
        """Peel off whole sequences, keep the remainder, and fill sequences when enough remainders wait."""
        limits = self.limits
        while part.size >= limits.tokens and (n := part.longest(limits.tokens, limits.loss_tokens)):
            self._place(part, n, 0)
            self.next_id += 1
        if part.size:
            self.waiting.append(Part(part.doc_id, part.ids, part.start, part.loss_from))
            self.held += part.size
        if len(self.waiting) >= limits.waiting:
            while len(self.waiting) > limits.waiting // 2 and self.held >= limits.tokens:
                self._fill(limits.tokens)

    def finish(self) -> None:
        """The last tokens go to sequences that are full or a power of two long, as neither is padded."""
        while self.held >= self.limits.tokens:
            self._fill(self.limits.tokens)
        while self.waiting:
            self._fill(1 << (self.held.bit_length() - 1))

    def _place(self, part: Part, n: int, offset: int) -> None:
        ids = part.ids[4 * part.start : 4 * (part.start + n)]
        total = len(part.ids) // 4
        self.rows.append(
            (part.doc_id, part.start, n, zlib.crc32(ids), total, self.next_id, offset, part.loss(n))
        )
        part.start += n

    def _fill(self, tokens: int) -> None:
        """One sequence of at most ``tokens`` tokens from the waiting examples."""
        limits, parts = self.limits, self.waiting
        whole = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        left = np.array([tokens, limits.segments, limits.loss_tokens], float)
        size = np.array([len(p.ids) // 4 - p.start for p in parts])
        cut = np.array([p.loss_from - p.start for p in parts])
        need = np.column_stack([size, np.ones(len(parts)), np.maximum(size - np.maximum(cut, 0), 0)])
        open_, offset, placed = np.ones(len(parts), bool), 0, []
        while left.min() >= 0 and left[0] > 0 and left[1] > 0 and open_.any():
            fits = open_ & (need <= left).all(axis=1)
            if left[1] == 1:  # the last segment: only one that fills up the tokens will do
                fits &= need[:, 0] == left[0]
            if fits.any():
                score = np.where(fits, (need / whole) @ (left / whole), -1.0)
                at = int(score.argmax())
                n = parts[at].size
            else:  # nothing fits whole: cut the one that fills most
                most = np.minimum(np.minimum(need[:, 0], left[0]), np.maximum(cut, 0) + left[2])
                most[~open_] = 0
                at = int(most.argmax())
                n = int(most[at])
                if not n:
                    break
            loss = parts[at].loss(n)
            self._place(parts[at], n, offset)
            placed.append((parts[at], n))
            offset += n
            left -= (n, 1, loss)
            need[at] = (parts[at].size, 1, parts[at].loss(parts[at].size))
            cut[at] = parts[at].loss_from - parts[at].start
            open_[at] = False
        if offset < limits.tokens:
            offset = self._shorten(placed, offset)
        self.held -= offset
        self.next_id += 1
        self.waiting = [p for p in parts if p.size]

    def _shorten(self, placed: list[tuple[Part, int]], total: int) -> int:
        """Take back the last tokens of a sequence that a limit ended early, until its length is a power of two."""
        short = 1 << (total.bit_length() - 1) if total else 0
        while total > short:
            part, n = placed.pop()
            self.rows.pop()
            part.start -= n
            total -= n
            if total < short:
                self._place(part, short - total, total)
                total = short
        return total

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(
    examples: DataFrame,
    limits: Limits = Limits(),
    tokenizer_file: str | None = None,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_from_col: str | None = None,
) -> DataFrame:
    """One row per piece: where it lies in its example and in its sequence.

    ``loss_from_col`` names the first loss-bearing token of an example, as in
    prompt-completion data; without it all tokens bear loss.  ``end_id`` is put
    behind every example.  Each id lies in exactly one piece; pieces of a
    sequence follow each other without gaps from offset 0.

    A null or empty text is its end id alone (no piece at all without an end
    id); a null ``loss_from`` counts as 0; repeated rows are packed one by one;
    an empty table gives no rows; other columns are ignored.  Every task packs
    its own rows as they come, nothing is exchanged, and at most a handful of
    sequences per task are not full.  Among equal choices the first one waiting
    is taken.  ``sequence_id`` holds the task's number in its upper bits.
    """
    bounded_batches(examples.sparkSession)
    spec = read_file(tokenizer_file or default_file())
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")
    names = [field.split()[0] for field in PIECES.split(", ")]
    loss_from = F.coalesce(F.col(loss_from_col).cast("bigint"), F.lit(0)) if loss_from_col else F.lit(0).cast("bigint")
    rows = examples.withColumns({"__loss_from": loss_from}).select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), "__loss_from"
    )

    def place(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        def table(found):
            return pa.RecordBatch.from_arrays(
                [pa.array(list(column), pa.int64()) for column in zip(*found)], names
            )

        gc.disable()  # nothing here refers to itself, and looking for that among many words takes long
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        cache = IdCache(spec)
        for batch in batches:
            ids = cache.batch(batch.column("text").to_pylist())
            for doc_id, own, first in zip(batch.column("doc_id").to_pylist(), ids, batch.column("__loss_from").to_pylist()):
                packer.add(Part(doc_id, own + tail, 0, first))
            if found := packer.take():
                yield table(found)
        packer.finish()
        if found := packer.take():
            yield table(found)
        gc.enable()

    return rows.mapInArrow(place, PIECES)
