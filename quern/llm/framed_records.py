"""Token-id files of length-delimited binary records with masked checksums and a separate offset index.

A record is, little-endian:

    uint64 length of the payload
    uint32 masked checksum of those eight bytes
    payload: the ids of one document as unsigned integers of `width` bytes: 2 where the vocabulary and the end id allow
           it, else 4
    uint32 masked checksum of the payload

The checksum is CRC-32, rotated right by 15 bits and increased by 0xA282EAD8, as files of this kind mask
theirs (they take CRC-32C, for which no compiled routine is at hand here).

Documents are dealt to shards by ranges of doc_id and, among equal ids, of how the text begins, so that one id with many
rows spreads over shards; they are written in ascending order (equal ids: by text; null ids first), one file per shard
below one folder of the shared store, SHARD_BYTES of text or so in each.  A task writes a name of its own and renames it at the end, so a
task that is run again leaves the same file.  The index is a Parquet table beside the files: shard, ordinal, doc_id,
offset, n_bytes, n_tokens, before (ids of the shard's earlier documents), width.  A reader can thus fetch any
records in any order.

Defined results.  A null text is an empty one: a record with the end id alone.  Repeated rows are separate
records.  A very long text is one record, held in memory by its task.  An id that does not fit in the chosen width
raises OverflowError.  An empty table gives no file and an empty index.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import partitions, require, scratch
from quern.llm.token_cache import vocabulary_size

INDEX = "shard int, ordinal long, doc_id long, offset long, n_bytes long, n_tokens long, before long, width int"
#: Bytes of text in a shard, about, where there are more than the shuffle partitions hold.
SHARD_BYTES = 1 << 30
#: Texts tokenized at one time.
STEP = 256


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + struct.pack("<I", masked(head)) + payload + struct.pack("<I", masked(payload))


def unframe(raw: bytes) -> bytes:
    """The payload of one record; ValueError if it is cut short or damaged."""
    if len(raw) < 16 or struct.unpack_from("<I", raw, 8)[0] != masked(raw[:8]):
        raise ValueError("damaged record header")
    size = struct.unpack_from("<Q", raw)[0]
    payload = raw[12 : 12 + size]
    if len(raw) != size + 16 or struct.unpack_from("<I", raw, 12 + size)[0] != masked(payload):
        raise ValueError("damaged record")
    return payload


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def packed(ids: bytes, width: int) -> bytes:
    """Little-endian uint32 ids in `width` bytes each; OverflowError if one does not fit."""
    plain = np.frombuffer(ids, "<u4")
    if len(plain) and int(plain.max()) >> 8 * width:
        raise OverflowError(f"id {plain.max()} does not fit in {width} bytes")
    return plain.astype(f"<u{width}").tobytes()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, kind: str, end_id: int, shards: int = 0) -> DataFrame:
    """Write doc_id, text below folder; return the index, read from the table written there."""
    spark = docs.sparkSession
    rows = require(docs, "doc_id", "text")
    width = 2 if max(vocabulary_size(tokenizer), end_id + 1) <= 1 << 16 else 4
    if not shards:
        total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
        shards = max(partitions(spark), -(-total // SHARD_BYTES))
    first = F.col("doc_id").asc_nulls_first()
    dealt = rows.repartitionByRange(shards, first, F.left("text", F.lit(64)).asc()).sortWithinPartitions(first, "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        from quern.llm.token_cache import encoder

        code = encoder(tokenizer, kind)
        store, base = _store(folder)
        shard, out = TaskContext.get().partitionId(), None
        temporary, final = f"{base}/{shard:08d}.{uuid.uuid4().hex}.part", f"{base}/{shard:08d}.rec"
        ordinal = offset = before = 0
        end = np.array([end_id], "<u4").tobytes()
        types = [pa.int32()] + [pa.int64()] * 6 + [pa.int32()]
        names = ["shard", "ordinal", "doc_id", "offset", "n_bytes", "n_tokens", "before", "width"]
        for batch in batches:
            index: list[list] = [[] for _ in names]
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                if out is None:
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(temporary)
                ids = code.encode_all([t or "" for t in part.column("text").to_pylist()])
                for doc, raw in zip(part.column("doc_id").to_pylist(), ids):
                    tokens = len(raw) // 4 + 1
                    record = frame(packed(raw + end, width))
                    out.write(record)
                    for column, value in zip(index, (shard, ordinal, doc, offset, len(record), tokens, before, width)):
                        column.append(value)
                    ordinal, offset, before = ordinal + 1, offset + len(record), before + tokens
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(index, types)], names)
        if out:
            out.close()
            store.move(temporary, final)

    dealt.mapInArrow(write, INDEX).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def read_ids(index: DataFrame, folder: str) -> DataFrame:
    """(shard, ordinal, doc_id, before, ids): the records that the index rows name, ids as little-endian uint32 bytes."""
    n = partitions(index.sparkSession)
    rows = index.repartition(n, "shard").sortWithinPartitions("shard", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _store(folder)
        shard = source = None
        for batch in batches:
            for at in range(0, batch.num_rows, STEP):
                part = batch.slice(at, STEP)
                ids = []
                for own, offset, size, width in zip(*(part.column(c).to_pylist() for c in ("shard", "offset", "n_bytes", "width"))):
                    if own != shard:
                        source, shard = store.open_input_file(f"{base}/{own:08d}.rec"), own
                    payload = unframe(source.read_at(size, offset))
                    ids.append(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes())
                kept = [part.column(c) for c in ("shard", "ordinal", "doc_id", "before")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ids, pa.binary())], ["shard", "ordinal", "doc_id", "before", "ids"])

    return rows.mapInArrow(read, "shard int, ordinal long, doc_id long, before long, ids binary")


def starts(index: DataFrame) -> DataFrame:
    """(shard, base): the ids in all earlier shards; one row a shard, so it may be broadcast."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """(doc_id, start, ids, shard, ordinal) of all documents, written to the shared folder and read back."""
    folder = scratch(spark, "records")
    index = write_ids(docs, folder, tokenizer, kind, end_id)
    read = read_ids(index, folder)
    return read.join(F.broadcast(starts(index)), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "ids", "shard", "ordinal")
