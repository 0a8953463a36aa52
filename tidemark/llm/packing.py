"""Cost-balanced packing of tokenised documents into sequences of fixed length."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import cached_property
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import in_pieces, per_worker, whole_texts

#: Tokens of a sequence, id that ends a document, attention cost of n tokens: LINEAR * n + QUADRATIC * n * n.
LENGTH, END, LINEAR, QUADRATIC = 2048, 1, 1.0, 1.0 / 1024
#: Documents packed together, and tokens at which a window closes before it has as many; pieces of a batch that goes out.
WINDOW, TOKENS, PIECES = 8192, 1 << 20, 1024


class Encoder:
    """Ids of whole texts as little-endian 32-bit words, by a tokenizer file of the tokenizers library.

    The same byte-level vocabulary is given to tiktoken, which yields the same ids some four times as fast: its tokens' ids rise in the order
    of their merges. Texts that hold an added token, or a run of LONG characters without a space, go to tokenizers itself.
    """

    LONG = 5_000

    def __init__(self, path: str):
        import tiktoken

        self.path, file = path, json.loads(Path(path).read_text("utf-8"))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
        self.added = [t["content"] for t in file["added_tokens"]]
        ranks = {bytes(map(byte.__getitem__, token)): i for token, i in file["model"]["vocab"].items() if token not in self.added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def tokenizer(self):
        """The library's own, which takes as much memory again; few workers meet a text for it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def encode(self, text: str) -> bytes:
        """The ids of a text."""
        if any(a in text for a in self.added) or len(text) > self.LONG and max(map(len, text.split(" "))) > self.LONG:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()


def pack(lengths: list[int], room: int, last: bool) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Packs pieces of documents, of less than room tokens each, into full sequences.

    Gives the placed pieces (piece, start in it, length, sequence, offset) and what is left over (piece, start, length), under room tokens.
    Pieces go in descending order of cost, each to the sequence of lowest cost so far among those with room for all of it. Where none has
    that, the sequence of lowest cost with any room is filled with the first part and the rest goes on as a piece. With last, what is
    left over also is placed, in sequences whose lengths are powers of two, which need no padding.
    """
    total = sum(lengths)
    n = total // room
    placed, rest = [], []
    cost, free = np.zeros(n), np.full(n, room)
    order = [(-size, i, 0) for i, size in enumerate(lengths) if size]
    heapq.heapify(order)
    while order:
        size, i, start = heapq.heappop(order)
        size = -size
        fits = np.flatnonzero(free >= size)
        some = fits if len(fits) else np.flatnonzero(free)
        if not len(some):
            rest.append((i, start, size))
            continue
        q = int(some[np.argmin(cost[some])])
        take = min(size, int(free[q]))
        placed.append((i, start, take, q, room - int(free[q])))
        cost[q] += LINEAR * take + QUADRATIC * take * take
        free[q] -= take
        if take < size:
            heapq.heappush(order, (take - size, i, start + take))
    if last:
        left = sum(size for _, _, size in rest)
        bins = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
        used = 0
        for i, start, size in rest:
            while size:
                take = min(size, bins[0] - used)
                placed.append((i, start, take, n, used))
                start, size, used = start + take, size - take, used + take
                if used == bins[0]:
                    bins.pop(0)
                    n, used = n + 1, 0
        rest = []
    return placed, rest


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids (binary: little-endian 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are the tokenizer's, without special tokens of its own, then `end`. Null text counts as empty; its only id is `end`.
    Documents with null or repeated ids are packed like any other; other columns are left out. An empty table gives an empty table.

    Each task packs the rows that it scans, a window of documents (by number and tokens) at a time, so nothing is shuffled. Whole sequences are cut from long
    documents first. The remainders are packed by cost (see pack); what a window leaves over goes on to the next window, and
    at the end of a task into sequences of power-of-two lengths, so that no sequence needs padding. sequence_id holds the task's partition
    above 32 bits, so a task that runs again gives the same rows.
    """
    kind = docs.schema[doc_id].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, number = per_worker(("encoder", tokenizer), lambda: Encoder(tokenizer)), TaskContext.get().partitionId() << 32
        left: list[tuple] = []  # (doc_id, ids, start in the document, its tokens)

        def pieces(rows: list[tuple], last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number, left
            out: list[tuple] = []
            whole = []
            for key, ids, start, tokens in rows:
                full = len(ids) // (4 * length)
                out += [(key, start + i * length, length, ids[4 * i * length : 4 * (i + 1) * length], tokens, number + i, 0) for i in range(full)]
                number += full
                whole.append((key, ids[4 * full * length :], start + full * length, tokens))
            placed, rest = pack([len(r[1]) // 4 for r in whole], length, last)
            for i, at, size, q, offset in placed:
                key, ids, start, tokens = whole[i]
                out.append((key, start + at, size, ids[4 * at : 4 * (at + size)], tokens, number + q, offset))
            number += 1 + max((p[3] for p in placed), default=-1)
            left = [(whole[i][0], whole[i][1][4 * at : 4 * (at + size)], whole[i][2] + at, whole[i][3]) for i, at, size in rest]
            for i in range(0, len(out), PIECES):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + PIECES], strict=True), [key_type, *types], strict=True)], names)

        key_type: pa.DataType | None = None
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        tail = np.asarray([end], "<u4").tobytes()
        rows, held = [], 0
        for batch in whole_texts(batches):
            key_type = batch.schema.field(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = coder.encode(text.as_py() or "") + tail
                rows.append((key, ids, 0, len(ids) // 4))
                held += len(ids) // 4
                if len(rows) == WINDOW or held >= TOKENS:
                    yield from pieces(left + rows, False)
                    rows, held = [], 0
        if left or rows:
            yield from pieces(left + rows, True)

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return in_pieces(rows).mapInArrow(run, f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
