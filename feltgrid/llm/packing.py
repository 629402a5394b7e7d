"""Hierarchical packing of tokenised documents into sequences of several lengths.

Each task tokenises the documents of its file split and packs them as it goes, so no text and no
token is shuffled and a task holds one chunk of tokens at most. Windows have power-of-two lengths up
to ``width`` and are filled completely, so there is no padding:

1. A document longer than ``width`` is cut into full windows; only its rest is packed.
2. Rests are routed to the tier of the smallest window that holds them, long tiers first.
3. The gap of a window takes the longest rest that fits, which comes from a shorter tier. Only when none
   fits, one is cut to close the gap; what is left of it is routed again.
4. What a task holds at its end is cut at powers of two.
5. Sequences of all tiers are dealt to step groups that hold the same number of tokens each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feltgrid.llm.frames import column, slices, texts
from feltgrid.llm.tokens import encoder

WIDTH = 2048
SHORTEST = 256
END_ID = 1
STEP_SEQUENCES = 8
CHUNK_TOKENS = 2_000_000
TOKENIZER = "byte_bpe_50k.json"

Piece = tuple[int, int, int]  # document of the chunk, first id, number of ids


def largest_power(n: int) -> int:
    return 1 << (n.bit_length() - 1)


class Rests:
    """Pieces by length, with the longest one of at most a given length found from a bit mask."""

    def __init__(self, width: int):
        self.by_length: list[list[Piece]] = [[] for _ in range(width + 1)]
        self.mask = 0

    def add(self, piece: Piece) -> None:
        if not self.by_length[piece[2]]:
            self.mask |= 1 << piece[2]
        self.by_length[piece[2]].append(piece)

    def take(self, length: int) -> Piece:
        piece = self.by_length[length].pop()
        if not self.by_length[length]:
            self.mask ^= 1 << length
        return piece

    def longest(self, most: int) -> int:
        """Length of the longest piece of at most ``most`` ids, 0 if there is none."""
        return max(0, (self.mask & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def shortest(self) -> int:
        return (self.mask & -self.mask).bit_length() - 1 if self.mask else 0


def pack(rests: Rests, width: int, shortest_tier: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Completely filled windows, and the pieces of the one window that could not be filled."""
    windows = []
    while longest := rests.longest(width):
        tier = min(width, max(shortest_tier, largest_power(2 * longest - 1)))
        window, gap = [rests.take(longest)], tier - longest
        while gap:
            if fits := rests.longest(gap):
                window.append(rests.take(fits))
                gap -= fits
            elif over := rests.shortest():
                doc, start, n = rests.take(over)
                window.append((doc, start, gap))
                rests.add((doc, start + gap, n - gap))
                gap = 0
            else:
                return windows, window
        windows.append(window)
    return windows, []


def cut_at_powers(pieces: list[Piece]) -> list[list[Piece]]:
    """Windows whose lengths are the powers of two in the number of ids of ``pieces``."""
    left = sum(n for _, _, n in pieces)
    windows, window, room = [], [], largest_power(left) if left else 0
    for doc, start, n in pieces:
        while n:
            part = min(n, room)
            window.append((doc, start, part))
            start, n, room, left = start + part, n - part, room - part, left - part
            if not room:
                windows.append(window)
                window, room = [], largest_power(left) if left else 0
    return windows


class Chunk:
    """The documents whose rests are not packed yet, and the rows of the pieces that are."""

    def __init__(self, width: int, shortest_tier: int, step_tokens: int, first_id: int):
        self.width, self.shortest_tier, self.step_tokens = width, shortest_tier, step_tokens
        self.docs: list[tuple[object, np.ndarray]] = []
        self.rests, self.windows, self.tokens = Rests(width), [], 0
        self.next_sequence = self.next_step = first_id
        self.room = step_tokens

    def add(self, doc_id: object, ids: np.ndarray) -> None:
        doc, full = len(self.docs), len(ids) - len(ids) % self.width
        self.docs.append((doc_id, ids))
        self.tokens += len(ids)
        self.windows += [[(doc, at, self.width)] for at in range(0, full, self.width)]
        if full < len(ids):
            self.rests.add((doc, full, len(ids) - full))

    def flush(self, last: bool) -> pa.RecordBatch:
        """The pieces of all filled windows; an unfilled window stays for the next chunk or is cut at the end."""
        packed, open_window = pack(self.rests, self.width, self.shortest_tier)
        windows = self.windows + packed + (cut_at_powers(open_window) if last else [])
        rows: dict[str, list] = {k: [] for k in SCHEMA_NAMES}
        # Long sequences first: powers of two fill a step group exactly.
        for window in sorted(windows, key=lambda w: -sum(n for _, _, n in w)):
            size = sum(n for _, _, n in window)
            if size > self.room:
                self.next_step, self.room = self.next_step + 1, self.step_tokens
            self.room -= size
            offset = 0
            for doc, start, n in window:
                doc_id, ids = self.docs[doc]
                values = (doc_id, start, n, zlib.crc32(ids[start : start + n].tobytes()), len(ids), self.next_sequence, offset, size, self.next_step)
                for k, v in zip(SCHEMA_NAMES, values):
                    rows[k].append(v)
                offset += n
            self.next_sequence += 1
        kept = {} if last else {doc: None for doc, _, _ in open_window}
        docs, self.docs, self.rests, self.windows, self.tokens = self.docs, [], Rests(self.width), [], 0
        for doc in kept:
            kept[doc] = len(self.docs)
            self.docs.append(docs[doc])
        if not last:
            for doc, start, n in open_window:
                self.rests.add((kept[doc], start, n))
        return rows


SCHEMA_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_id"]


def pack_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer: str | None = None,
    width: int = WIDTH,
    shortest_tier: int = SHORTEST,
    step_sequences: int = STEP_SEQUENCES,
    chunk_tokens: int = CHUNK_TOKENS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece of a document and its place in a sequence.

    ``width`` and ``shortest_tier`` are powers of two. A null or empty text is the end id alone; a
    null id is kept; repeated rows are packed each for itself; other columns are left out. An empty
    table gives no rows. Sequence and step ids are unique over the table: the task's number stands in
    their upper bits.
    """
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    key = docs.schema[doc_id].dataType
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path).ids_with_added, np.array([end_id], "<u4")
        chunk, kind = Chunk(width, shortest_tier, step_sequences * width, TaskContext.get().partitionId() << 33), None

        def batch_of(rows: dict[str, list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({k: pa.array(v, kind if k == "doc_id" else pa.int64()) for k, v in rows.items()})

        for batch in slices(batches, "text"):
            kind = batch.schema.field("doc_id").type
            for key_value, t in zip(column(batch, "doc_id"), texts(batch, "text")):
                chunk.add(key_value, np.concatenate([encode(t), end]))
                if chunk.tokens >= chunk_tokens:
                    yield batch_of(chunk.flush(last=False))
        if kind is not None:
            yield batch_of(chunk.flush(last=True))

    return source.mapInArrow(run, f"doc_id {key.simpleString()}, " + ", ".join(f"{k} long" for k in SCHEMA_NAMES[1:]))
