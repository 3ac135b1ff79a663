"""Vector bin packing of examples into training sequences, by the dot-product heuristic.

An example has three demands: tokens, segments (one for each piece) and loss-bearing tokens. An open sequence has what is left
of its three limits. Of the waiting examples that fit in all three, the one with the largest dot product of demands and
rest (both in parts of the limits) goes in; if none fits, the longest one is cut to fill what is left. Whole limits' worth of a long
example become sequences at once. Each task packs its own rows, a pool at a time, so nothing is shuffled, and memory is
bounded by the pool; the last pool of a task ends in sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, quoted
from .tokens import encoded

MAX_TOKENS, MAX_SEGMENTS, POOL = 2048, 256, 512
END_ID = 1


class VectorPacker:
    """Places items (tokens, loss) and says where: place() gives pieces (item, start, length, sequence, offset).

    An item's loss-bearing tokens are its last ones, as an answer follows its prompt.
    """

    def __init__(self, max_tokens=MAX_TOKENS, max_segments=MAX_SEGMENTS, max_loss=None, pool=POOL):
        self.limits = np.array([max_tokens, max_segments, max_loss or max_tokens], float)
        if (self.limits < 1).any():
            raise ValueError("each limit must be at least 1")
        self.max_tokens, self.max_segments, self.max_loss, self.pool = max_tokens, max_segments, int(self.limits[2]), pool
        self.sequences = 0
        self.waiting: list[list[int]] = []  # item, start, tokens, loss

    def _open(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _head(self, tokens: int, loss: int, rest_tokens: int, rest_loss: int) -> int:
        """How many of an item's first tokens fit: those before the loss-bearing ones are free of the third limit."""
        return min(tokens, rest_tokens, tokens - loss + rest_loss)

    def add(self, item: int, tokens: int, loss: int | None = None):
        loss = tokens if loss is None else min(loss, tokens)
        start = 0
        while tokens >= self.max_tokens and (n := self._head(tokens, loss, self.max_tokens, self.max_loss)) == self.max_tokens:
            yield item, start, n, self._open(), 0
            start, tokens, loss = start + n, tokens - n, min(loss, tokens - n)
        if tokens:
            self.waiting.append([item, start, tokens, loss])
        if len(self.waiting) >= self.pool:
            yield from self.place()

    def place(self, last: bool = False):
        """Fill sequences from what waits; the items of the last one, if it isn't full, wait on unless last."""
        items = self.waiting
        size = np.array([[x[2], 1, x[3]] for x in items], float).reshape(-1, 3)
        there = np.ones(len(items), bool)
        self.waiting = []
        left = len(items)
        while left:
            rest, chosen, offset = self.limits.copy(), [], 0
            while left and rest[0] > 0 and rest[1] > 0:
                fits = there & (size <= rest).all(axis=1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, (size / self.limits) @ (rest / self.limits), -1.0)))
                    n = items[k][2]
                else:
                    k = int(np.argmax(np.where(there, size[:, 0], -1.0)))
                    n = self._head(items[k][2], items[k][3], int(rest[0]), int(rest[2]))
                    if n <= 0:
                        break
                item, start, tokens, loss = items[k]
                after = min(loss, tokens - n)
                chosen.append((item, start, n, loss - after))
                rest -= (n, 1, loss - after)
                offset += n
                if n == tokens:
                    there[k] = False
                    left -= 1
                else:
                    items[k] = [item, start + n, tokens - n, after]
                    size[k] = tokens - n, 1, after
            if left or rest[0] == 0 or rest[1] == 0:
                yield from self._write(chosen)
            elif not last:
                self.waiting = [list(x) for x in chosen]
            else:
                yield from self._powers(chosen, offset)

    def _write(self, chosen):
        sequence, offset = self._open(), 0
        for item, start, n, _ in chosen:
            yield item, start, n, sequence, offset
            offset += n

    def _powers(self, chosen, total: int):
        queue = [list(x[:3]) for x in chosen][::-1]
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            sequence, offset = self._open(), 0
            while offset < room:
                item, start, n = queue.pop()
                k = min(n, room - offset)
                yield item, start, k, sequence, offset
                offset += k
                if k < n:
                    queue.append([item, start + k, n - k])


def _pack(text_at: int, id_at: int, prompt_at: int | None, path: str, names: list[str], limits: dict, end_id: int | None):
    end = np.array([] if end_id is None else [end_id], "<u4").tobytes()

    def run(batches):
        packer = VectorPacker(**limits)
        base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        ids, data, n = {}, {}, 0
        rows: list[tuple] = []

        def take(pieces):
            for item, start, k, sequence, offset in pieces:
                whole = data[item]
                rows.append((ids[item], start, k, zlib.crc32(whole[4 * start : 4 * (start + k)]), len(whole) // 4, base + sequence, offset))

        def flush(id_type):
            out = list(zip(*rows, strict=True)) or [[]] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0], id_type), *(pa.array(x, pa.int64()) for x in out[1:])], names)

        kind = None
        for b, encodings in encoded(batches, text_at, path):
            kind = b.column(id_at).type
            prompts = b.column(prompt_at).to_pylist() if prompt_at is not None else [0] * b.num_rows
            for one, own, prompt in zip(b.column(id_at).to_pylist(), encodings, prompts, strict=True):
                ids[n], data[n] = one, own + end
                tokens = len(data[n]) // 4
                take(packer.add(n, tokens, max(0, tokens - (prompt or 0))))
                n += 1
            here = {x[0] for x in packer.waiting}
            ids, data = {k: ids[k] for k in here}, {k: data[k] for k in here}
            yield flush(kind)
        take(packer.place(last=True))
        if rows:
            yield flush(kind)

    return run


def pack_texts(
    df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None, end_id: int | None = END_ID
) -> DataFrame:
    """One row per piece: the id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each text is encoded whole, end_id follows (None: nothing); its pieces cover each id once. prompt_col (a count of
    leading tokens that bear no loss, null as 0) makes an example's loss smaller than its tokens; without it all tokens bear loss.
    A sequence's pieces lie one after the other from offset 0, within the limits of tokens, segments and loss.

    Null or empty text: only the end id (without one: no piece). Null ids and rows that repeat an id are packed like any
    others. An empty table gives no rows. Extra columns are ignored, whatever their names; an id called like an output column keeps its
    name and that column gets underscores in front.
    """
    names = [id_col]
    for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"):
        names.append(fresh(names, n))
    slim = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"), *([quoted(prompt_col).cast("long").alias("prompt")] if prompt_col else []))
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *(T.StructField(n, T.LongType()) for n in names[1:])])
    limits = {"max_tokens": max_tokens, "max_segments": max_segments, "max_loss": max_loss}
    return slim.mapInArrow(_pack(1, 0, 2 if prompt_col else None, tokenizer_path, names, limits, end_id), schema)


def sequence_fill(pieces: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """For each sequence: pieces, tokens, padding (none at a power of two)."""
    t = F.sum("length")
    return pieces.groupBy("sequence_id").agg(F.count("*").alias("pieces"), t.alias("tokens"), F.when(F.sum("length").bitwiseAND(F.sum("length") - 1) == 0, 0).otherwise(max_tokens - t).alias("padding"))
