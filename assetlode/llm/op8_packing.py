"""Packing by reciprocal-capacity classes.

With a capacity C, class k holds pieces of at most C // k ids and more than
C // (k + 1), for k below CLASSES; a bin of class k is closed as soon as it has
k pieces, so filling a class needs no search and each partition packs what it
reads by itself. Pieces of at most C // CLASSES ids form the last class, which
fills its bin up and cuts the piece that crosses the end.

A document is cut into whole sequences first. What remains would waste
C // k - length ids in class k; where that is more than SLACK of the slot, the
remainder is cut to the full slot of class k + 1, which wastes nothing, and the
rest goes on the same way. When a partition ends, its open bins hold fewer
pieces than their class asks for; their pieces are laid end to end into whole
sequences, and the last one is cut at powers of two, which need no padding.

Each piece is written once, to one sequence; the ids of a document are a fixed
function of its text, and the order of rows in an input partition is that of its
files, so a task that runs again after a loss gives the same pieces.

Defined results: a null or empty text is one end id. Rows that share an id are
packed row by row. A null id stays null. An empty table gives no rows. Other
columns are not read. The string of a special token in a text gets the id that the
library gives it, unless special_as_text is set.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from assetlode.llm.batches import columns, documents, map_stream, texts_of
from assetlode.llm.encode import Encoder

CAPACITY = 2048
END_ID = 1
#: Classes by count; the last takes all that is shorter.
CLASSES = 32
#: Part of a slot that a piece may leave free.
SLACK = 1 / 64


class Piece(NamedTuple):
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int


Sequence = list[Piece]


def split(length: int, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> list[tuple[int, int]]:
    """Lengths of the pieces of a document, each with its class."""
    out = [(capacity, 1)] * (length // capacity)
    rest = length % capacity
    while rest:
        k = capacity // rest
        if k >= classes:
            out.append((rest, classes))
            break
        slot = capacity // k
        if slot - rest <= slack * slot:
            out.append((rest, k))
            break
        out.append((capacity // (k + 1), k + 1))
        rest -= capacity // (k + 1)
    return out


class Packer:
    """Open bins of one worker: at most one for each class."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK) -> None:
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.open: dict[int, Sequence] = {}
        self.small = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[Sequence]:
        """Takes in a document; gives the sequences that it closes."""
        at = 0
        for length, k in split(len(ids), self.capacity, self.classes, self.slack):
            piece = Piece(doc_id, at, ids[at : at + length], len(ids))
            at += length
            if k == 1:
                yield [piece]
            elif k < self.classes:
                held = self.open.setdefault(k, [])
                held.append(piece)
                if len(held) == k:
                    yield self.open.pop(k)
            else:
                yield from self._fill(piece)

    def _fill(self, piece: Piece) -> Iterator[Sequence]:
        room = self.capacity - self.small
        held = self.open.setdefault(self.classes, [])
        held.append(_part(piece, 0, room))
        self.small += len(held[-1].ids)
        if self.small == self.capacity:
            yield self.open.pop(self.classes)
            self.small = 0
            if len(piece.ids) > room:
                yield from self._fill(_part(piece, room, len(piece.ids)))

    def close(self) -> Iterator[Sequence]:
        """The sequences of what bins still hold."""
        held = [p for k in sorted(self.open) for p in self.open[k]]
        self.open, self.small = {}, 0
        left = sum(len(p.ids) for p in held)
        while left:
            size = self.capacity if left >= self.capacity else 1 << left.bit_length() - 1
            left -= size
            sequence = []
            while size:
                piece = held.pop(0)
                if len(piece.ids) > size:
                    held.insert(0, _part(piece, size, len(piece.ids)))
                    piece = _part(piece, 0, size)
                sequence.append(piece)
                size -= len(piece.ids)
            yield sequence


def _part(piece: Piece, lo: int, hi: int) -> Piece:
    return Piece(piece.doc_id, piece.start + lo, piece.ids[lo:hi], piece.doc_tokens)


def padded(length: int, capacity: int = CAPACITY) -> int:
    """Length of a written sequence: a power of two stays, anything else is filled up."""
    return length if length & length - 1 == 0 else capacity


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, special_as_text: bool = False) -> DataFrame:
    """A row for each piece: where it stands in its document and in its sequence; with_ids adds the ids themselves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        partition, number, packer, encoder = TaskContext.get().partitionId(), 0, Packer(capacity), None

        def rows(sequences: Iterator[Sequence]) -> Iterator[tuple]:
            nonlocal number
            for sequence in sequences:
                offset, sequence_id = 0, partition << 40 | number
                number += 1
                for p in sequence:
                    yield (p.doc_id, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.doc_tokens, sequence_id, offset, *([p.ids] if with_ids else []))
                    offset += len(p.ids)

        for batch in batches:
            encoder = encoder or Encoder.shared(tokenizer, special_as_text)
            ids, texts = columns(batch)
            out = []
            for doc_id, text in zip(ids.to_pylist(), texts, strict=True):
                out += rows(packer.add(doc_id, np.append(encoder.ids(text), np.uint32(end_id))))
            if out:
                yield _batch(out)
        if out := list(rows(packer.close())):
            yield _batch(out)

    return map_stream(texts_of(docs), each, SCHEMA + (", ids array<long>" if with_ids else ""))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) if i < 7 else pa.array(c, pa.list_(pa.int64())) for i, c in enumerate(zip(*rows, strict=True))], names[: len(rows[0])])


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
