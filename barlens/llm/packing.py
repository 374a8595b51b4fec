"""Packing of token documents into sequences by minimum bin slack.

Spark deals the documents to tasks; every task packs its own share, so no token is shuffled and no count passes
through the driver.  A document's ids are cut into whole windows of the capacity, which are sequences of their own, and
one remainder.  Remainders wait in a pool, a multiset of lengths.  For each window the longest one is taken, and a
subset-sum dynamic program over bitsets (bit s: the sum s can be reached) finds the multiset of the other lengths that
comes closest to the capacity; the counts are read back through the program's steps, and the same multiset fills as many
windows as the pool has copies of it.  Where no multiset fills a window, the shortest remainder that is left is cut
to fill it.  What cannot fill a window at the end of a task is written as sequences of powers of two,
which need no padding, so a task leaves none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlens.llm.tokenizing import byte_bpe, content

_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ROWS = 4096


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths (length -> how many, at most ``counts``) with the largest sum up to ``capacity``.
    Ties: the multiset that the longest lengths reach first."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    full = 1 << capacity
    for length in sorted((x for x, n in counts.items() if n > 0 and 0 < x <= capacity), reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left and not reach & full:  # a bounded count as a sum of powers of two
            n = min(part, left)
            steps.append((reach, length, n))
            reach |= (reach << (length * n)) & mask
            left, part = left - n, part * 2
        if reach & full:
            break
    at, out = reach.bit_length() - 1, {}
    for before, length, n in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + n
            at -= length * n
    return out


class Packer:
    """The pool of one task.  ``add`` takes documents, ``rows`` gives the pieces of the windows filled so far as
    (doc, start, length, sequence, offset); a document is any number the caller chooses."""

    def __init__(self, capacity: int = 2048, first: int = 0):
        self.capacity, self.sequence = capacity, first
        self.pool: dict[int, list[tuple[int, int]]] = {}
        self.waiting = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def add(self, doc: int, tokens: int) -> None:
        cap = self.capacity
        for start in range(0, tokens - cap + 1, cap):
            self.out.append((doc, start, cap, self.sequence, 0))
            self.sequence += 1
        if rest := tokens % cap:
            self._wait(rest, doc, tokens - rest)

    def _wait(self, length: int, doc: int, start: int) -> None:
        self.pool.setdefault(length, []).append((doc, start))
        self.waiting += length

    def _take(self, length: int) -> tuple[int, int]:
        items = self.pool[length]
        got = items.pop()
        if not items:
            del self.pool[length]
        self.waiting -= length
        return got

    def fill(self) -> None:
        """Fill windows while the pool holds a whole one."""
        cap = self.capacity
        while self.waiting >= cap:
            counts = {k: len(v) for k, v in self.pool.items()}
            longest = max(counts)
            counts[longest] -= 1
            chosen = closest(counts, cap - longest)
            chosen[longest] = chosen.get(longest, 0) + 1
            slack = cap - sum(k * n for k, n in chosen.items())
            copies = 1 if slack else min(len(self.pool[k]) // n for k, n in chosen.items())
            for _ in range(copies):
                at = 0
                for length in sorted(chosen, reverse=True):
                    for _ in range(chosen[length]):
                        at = self._put(*self._take(length), length, at)
                if slack:  # every remainder left is longer than the slack
                    length = min(self.pool)
                    doc, start = self._take(length)
                    self._put(doc, start, slack, at)
                    self._wait(length - slack, doc, start + slack)
                self.sequence += 1

    def _put(self, doc: int, start: int, length: int, at: int) -> int:
        self.out.append((doc, start, length, self.sequence, at))
        return at + length

    def finish(self) -> None:
        """The last remainders, less than a window in all, as sequences whose lengths are powers of two."""
        self.fill()
        items = [(length, *item) for length in sorted(self.pool, reverse=True) for item in self.pool[length]]
        self.pool, left, self.waiting = {}, self.waiting, 0
        for bit in range(left.bit_length() - 1, -1, -1):
            room, at = left & 1 << bit, 0
            if not room:
                continue
            while room:
                length, doc, start = items.pop(0)
                n = min(length, room)
                at = self._put(doc, start, n, at)
                room -= n
                if length > n:
                    items.insert(0, (length - n, doc, start + n))
            self.sequence += 1


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, pool_tokens: int = 1 << 21,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all rows: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    A document is the tokenizer's ids of the whole text (null: empty) and ``end_id`` (None: none; then an empty text has
    no piece).  ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers.  Every id of a document lies in
    one piece; ``start`` counts the ids before it.  A sequence's pieces follow each other without gaps from offset 0.
    Sequences hold ``capacity`` ids; the last ones of a task hold a power of two.  ``sequence_id`` is unique; it
    carries the number of the task.  Rows with a null or repeated id are documents of their own; other columns are ignored; an
    empty table has no row.  A task holds about ``pool_tokens`` ids, or one document, at a time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(content(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, end = byte_bpe(shared.value, True), np.array([] if end_id is None else [end_id], np.uint32)
        packer = Packer(capacity, TaskContext.get().partitionId() << 33)
        held: dict[int, tuple[int | None, int, int, np.ndarray]] = {}  # id, tokens, ids given away, the ids after them
        number, tokens = 0, 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.concatenate([bpe.encode(text.as_py() or ""), end])
                held[number] = (doc_id.as_py(), len(ids), 0, ids)
                packer.add(number, len(ids))
                number, tokens = number + 1, tokens + len(ids)
                if tokens >= pool_tokens:
                    packer.fill()
                    yield from _rows(packer, held)
                    waits = {d: start for items in packer.pool.values() for d, start in items}
                    held = {d: (held[d][0], held[d][1], at, held[d][3][at - held[d][2]:].copy()) for d, at in waits.items()}
                    tokens = packer.waiting
        packer.finish()
        yield from _rows(packer, held)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, _PIECES)


def _rows(packer: Packer, held: dict[int, tuple[int | None, int, int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    rows, packer.out = packer.out, []
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for i in range(0, len(rows), _ROWS):
        cols: list[list] = [[] for _ in names]
        for doc, start, length, sequence, offset in rows[i:i + _ROWS]:
            doc_id, total, base, ids = held[doc]
            for col, v in zip(cols, (doc_id, start, length, ids[start - base:start - base + length].astype("<u4").tobytes(), total, sequence, offset), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """The sequences themselves: ``sequence_id, length, ids`` with ``ids`` padded by ``pad_id`` to the capacity
    unless the length is a power of two.  A sequence's pieces, at most ``capacity``, meet in one row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    got = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p"))
    ids = F.aggregate("p", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    whole = (F.col("length") == capacity) | (F.expr("length & (length - 1)") == 0)
    pad = F.unhex(F.repeat(F.lit(f"{int(pad_id).to_bytes(4, 'little').hex()}"), F.when(whole, 0).otherwise(capacity - F.col("length")).cast("int")))
    return got.select("sequence_id", "length", F.concat(ids, pad).alias("ids"))
