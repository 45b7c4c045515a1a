"""Token ids in length-delimited binary records with a separate offset index.

File format of a shard `NAME.rec`: records one after another, each
    u64  length of the payload, little-endian
    u32  masked CRC-32 of the 8 length bytes
    payload: u8 1 if the document has an id, else 0; i64 document id; u8 width of a
             token id in bytes (2 or 4); u32 count of token ids; these, little-endian
    u32  masked CRC-32 of the payload
The mask is ((crc >> 15 | crc << 17) + 0xa282ead8) mod 2^32. `NAME.idx` holds a
u64 offset for each record, so a reader can seek to records in any order. Shards
are listed in ascending document order by a manifest (a Parquet table: shard,
file, records, tokens), which is what a reader starts from.

Documents are range-partitioned by id; each task streams its range into one
shard, whose name is unique to the attempt. A repeated or speculative attempt
writes another file, and the manifest names only the files of attempts that
finished, so a lost executor leaves no half-written shard in the data set.

Defined results: a null or empty text is one end id. Rows that share an id are
ordered by a hash of the text and the text, and may lie in several shards. Null ids
come first and read back as null. An empty table gives an empty manifest. Other
columns are not read. The string of a special token in a text gets the id that the
library gives it, unless special_as_text is set.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assetlode.llm.batches import columns, documents, map_stream, texts_of
from assetlode.llm.encode import Encoder
from assetlode.workspace import Workspace

END_ID = 0
MASK = 0xA282EAD8
#: Records read back in one batch, and bytes read at a time.
BATCH_RECORDS, READ_BYTES = 512, 8_000_000


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return struct.pack("<BqBI", doc_id is not None, doc_id or 0, width, len(ids)) + ids.astype(f"<u{width}").tobytes()


def unpack(data: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width, n = struct.unpack_from("<BqBI", data)
    return doc_id if known else None, np.frombuffer(data, f"<u{width}", n, 14).astype("<u4")


def records(stream: pa.NativeFile) -> Iterator[bytes]:
    """Payloads of a shard in order; a wrong checksum or a cut record is an error."""
    while head := stream.read(12):
        if len(head) < 12 or masked(head[:8]) != struct.unpack_from("<I", head, 8)[0]:
            raise ValueError("damaged record length")
        size = struct.unpack_from("<Q", head)[0]
        body = stream.read(size + 4)
        if len(body) < size + 4 or masked(body[:size]) != struct.unpack_from("<I", body, size)[0]:
            raise ValueError("damaged record")
        yield body[:size]


def read_at(path: str, offset: int) -> tuple[int | None, np.ndarray]:
    """One record of a shard, found by its offset from the index."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(at) as f:
        f.seek(offset)
        return unpack(next(records(f)))


def offsets(path: str) -> np.ndarray:
    """The offset index of a shard; path ends in .rec."""
    fs, at = pyarrow.fs.FileSystem.from_uri(path.removesuffix(".rec") + ".idx")
    with fs.open_input_stream(at) as f:
        return np.frombuffer(f.read(), "<u8")


def write(docs: DataFrame, out_dir: str, tokenizer: str, end_id: int = END_ID, shards: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Writes shards below out_dir and returns the manifest rows, one for each shard with records.

    Without a number of shards the session's shuffle settings decide it by size.

    Each evaluation of the result writes the shards, so save it once and read the saved rows.
    """
    texts = texts_of(docs)
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = texts.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order, "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, encoder = TaskContext.get().partitionId(), None
        name = f"{out_dir}/shard-{shard:06d}-{uuid.uuid4().hex}.rec"
        n_records, n_tokens, at, index, width = 0, 0, 0, [], 2
        fs, path = pyarrow.fs.FileSystem.from_uri(name)
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                encoder = Encoder.shared(tokenizer, special_as_text)
                width = 2 if encoder.vocabulary <= 1 << 16 else 4
                fs.create_dir(os.path.dirname(path), recursive=True)
                out = fs.open_output_stream(path, buffer_size=1 << 20)
            ids, rows = columns(batch)
            for doc_id, text in zip(ids.to_pylist(), rows, strict=True):
                tokens = np.append(encoder.ids(text), np.uint32(end_id))
                data = frame(payload(doc_id, tokens, width))
                out.write(data)
                index.append(at)
                at, n_records, n_tokens = at + len(data), n_records + 1, n_tokens + len(tokens)
        if out is None:
            return
        out.close()
        with fs.open_output_stream(path.removesuffix(".rec") + ".idx") as f:
            f.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [name], "n_records": pa.array([n_records], pa.int64()), "n_tokens": pa.array([n_tokens], pa.int64())})

    return map_stream(ordered, each, "shard long, file string, n_records long, n_tokens long")


def read(manifest: DataFrame) -> DataFrame:
    """Per record: doc_id, start (ids of all records before it), n_tokens and the ids' CRC-32, all from the files.

    The manifest has a row for each shard, so the running sum over it is small.
    """
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = manifest.select("file", before.cast("long").alias("base"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = pyarrow.fs.FileSystem.from_uri(name)
                rows: list[tuple] = []
                with fs.open_input_stream(path, buffer_size=READ_BYTES) as f:
                    for data in records(f):
                        doc_id, ids = unpack(data)
                        rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
                        start += len(ids)
                        if len(rows) == BATCH_RECORDS:
                            yield _batch(rows)
                            rows = []
                if rows:
                    yield _batch(rows)

    return map_stream(shards.repartition(max(1, manifest.count())), each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op7_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "records")
    manifest = ws.save(write(documents(spark, sf_dir), ws.path("shards"), public_tokenizers.path("byte_bpe_50k.json")), "manifest")
    return read(manifest)
