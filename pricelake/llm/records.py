"""Binary output: length-delimited records with masked checksums, and an offset index for shuffled reads.

File format, all numbers little-endian:

record file   for each record: length (uint64), masked CRC-32 of those 8 bytes
              (uint32), payload, masked CRC-32 of the payload (uint32)
payload       has an id (uint8), id (int64), bytes of a token id (uint8), number of ids (uint32),
              ids (uint16 each if the vocabulary and the end id fit in 16 bits, else uint32)
index file    the byte offset of each record (uint64 each), then the file's length
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_text, materialise
from .tokens import encoder, text_slices

_HEAD, _PAYLOAD = struct.Struct("<QI"), struct.Struct("<BqBI")
_MANIFEST = "shard int, path string, documents bigint, tokens bigint, bytes bigint"
_READ = "shard int, doc_id bigint, start_in_shard bigint, n_tokens bigint, ids_crc32 bigint"


def masked(crc: int) -> int:
    """A checksum rotated and moved, so that checksums of data holding checksums stay strong."""
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked(zlib.crc32(length))) + payload + struct.pack("<I", masked(zlib.crc32(payload)))


def read_record(f, offset: int | None = None) -> bytes | None:
    """The payload at ``offset`` (default: where the file stands), None at the end; ValueError if a checksum differs."""
    if offset is not None:
        f.seek(offset)
    head = f.read(_HEAD.size)
    if not head:
        return None
    if len(head) < _HEAD.size or masked(zlib.crc32(head[:8])) != _HEAD.unpack(head)[1]:
        raise ValueError("a record's length is damaged")
    n = _HEAD.unpack(head)[0]
    body = f.read(n + 4)
    if len(body) < n + 4 or masked(zlib.crc32(body[:n])) != struct.unpack("<I", body[n:])[0]:
        raise ValueError("a record's payload is damaged")
    return body[:n]


def id_width(vocabulary: int, end_id: int) -> int:
    """Bytes of a token id in the files: 2 where every id of the vocabulary and the end id fit, else 4."""
    return 2 if max(vocabulary - 1, end_id) < 1 << 16 else 4


def payload_of(doc: int | None, raw: bytes | memoryview, n: int, width: int = 4) -> bytes:
    """The payload of ``n`` ids, given as little-endian bytes."""
    return _PAYLOAD.pack(doc is not None, doc or 0, width, n) + raw


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    """The id and the token ids, as little-endian uint32 whatever their width in the file."""
    has, doc, width, n = _PAYLOAD.unpack_from(payload)
    return (doc if has else None), np.frombuffer(payload, f"<u{width}", n, _PAYLOAD.size).astype("<u4")


def _verified(f, offsets: list[int], seen: int) -> tuple[list[list], int]:
    """doc_id, start, length and checksum of the records at ``offsets`` but the last, which is where they end."""
    rows: list[list] = [[], [], [], []]
    f.seek(offsets[0])
    for begin, end in zip(offsets, offsets[1:]):
        if f.tell() != begin:
            raise ValueError("the index doesn't fit the records")
        doc, ids = unpack(read_record(f) or b"")
        if f.tell() != end:
            raise ValueError("the index doesn't fit the records")
        for col, v in zip(rows, (doc, seen, len(ids), zlib.crc32(ids.tobytes()))):
            col.append(v)
        seen += len(ids)
    return rows, seen


def write_records(docs: DataFrame, path: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, partitions: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as record and index files under the URI ``path``; the manifest: shard, path, documents, tokens, bytes.

    Rows are range-partitioned by id (ties by the text's checksum), so shard
    after shard the files hold ascending ids; a shard is one file.  Each
    attempt of a task writes a file of its own name and only the manifest says
    which one counts, so retries and speculative tasks do no harm.  The
    manifest is stored before it is returned.  A task holds one slice of texts
    and one index (8 bytes a record) in memory.

    Null or empty text: the end id alone.  Null ids come first and read back
    as null.  Repeated rows and equal ids give a record each.  Other columns
    are ignored, whatever their names.  An empty table gives no file.
    """
    rows = id_text(docs, id_col, text_col).withColumn("tie", F.crc32("text"))
    by = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    parts = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    parts = parts.sortWithinPartitions(*by).select("doc_id", "text", F.spark_partition_id().alias("shard"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, offsets, at, tokens, shard = encoder(tokenizer), [], 0, 0, None
        width = id_width(enc.largest_id + 1, end_id)
        where, root = fs.FileSystem.from_uri(path)
        name = f"{root}/part-{uuid.uuid4().hex}"
        out = None
        for part in parts:
            if not part.num_rows:
                continue
            shard = part.column(2)[0].as_py()
            if out is None:
                where.create_dir(root, recursive=True)
                out = where.open_output_stream(f"{name}.rec")
            for rows in text_slices(part):
                flat, bounds = enc.encode(rows.column(1), end_id)
                raw = memoryview(flat.astype(f"<u{width}").tobytes())
                for doc, lo, hi in zip(rows.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                    record = frame(payload_of(doc, raw[lo * width : hi * width], hi - lo, width))
                    out.write(record)
                    offsets.append(at)
                    at += len(record)
                tokens += len(flat)
        if out is not None:
            out.close()
            with where.open_output_stream(f"{name}.idx") as index:
                index.write(np.array([*offsets, at], "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [f"{path}/{name.rpartition('/')[2]}"], "documents": [len(offsets)], "tokens": [tokens], "bytes": [at]})

    return materialise(parts.mapInArrow(run, _MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each record, in file order, every checksum and offset verified.

    One task reads one file, through its index; `start` counts the ids of all
    records before it, over the shards in order.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, path in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(f"{name}.idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8")
                with where.open_input_file(f"{name}.rec") as f:
                    seen = 0
                    for at in range(0, len(offsets) - 1, 4096):
                        rows, seen = _verified(f, offsets[at : at + 4097].tolist(), seen)
                        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard] * len(rows[0]), pa.int32())} | {k: pa.array(c, pa.int64()) for k, c in zip(("doc_id", "start_in_shard", "n_tokens", "ids_crc32"), rows)})

    starts = manifest.select(F.col("shard").alias("s"), F.coalesce(F.sum("tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    n = manifest.sparkSession.sparkContext.defaultParallelism * 4
    got = manifest.select("shard", "path").repartition(n, "shard").mapInArrow(run, _READ)
    return got.join(F.broadcast(starts), got["shard"] == starts["s"]).select("doc_id", (F.col("shard_start") + F.col("start_in_shard")).alias("start"), "n_tokens", "ids_crc32")


def read_shuffled(manifest: DataFrame, seed: int, slice_records: int = 4096) -> DataFrame:
    """epoch_order, doc_id, n_tokens, ids of all records in an order that ``seed`` decides, each found by its offset.

    The index files alone give the (shard, record) numbers; these are ordered
    by a hash with the seed, and each task seeks its own records out, by file
    and offset inside a slice of the order.  `epoch_order` sorts the epoch: a
    hash, ties by shard and record.  Every record comes once; damaged records
    and offsets raise ValueError.  An empty manifest gives an empty result.
    """

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for shard, path in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                where, name = fs.FileSystem.from_uri(path)
                with where.open_input_stream(f"{name}.idx") as index:
                    offsets = np.frombuffer(index.read(), "<u8").astype(np.int64)[:-1]
                for at in range(0, len(offsets), 100_000):
                    some = offsets[at : at + 100_000]
                    yield pa.RecordBatch.from_pydict({
                        "shard": pa.array([shard] * len(some), pa.int32()), "path": [path] * len(some),
                        "record": pa.array(np.arange(at, at + len(some))), "offset": pa.array(some),
                    })

    def fetch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for lo in range(0, part.num_rows, slice_records):
                rows = part.slice(lo, slice_records)
                got: list = [None] * rows.num_rows
                paths, offsets = rows.column(1).to_pylist(), rows.column(2).to_pylist()
                by_file: dict[str, list[tuple[int, int]]] = {}
                for i, (path, offset) in enumerate(zip(paths, offsets)):
                    by_file.setdefault(path, []).append((offset, i))
                for path, wanted in by_file.items():
                    where, name = fs.FileSystem.from_uri(path)
                    with where.open_input_file(f"{name}.rec") as f:
                        for offset, i in sorted(wanted):
                            payload = read_record(f, offset)
                            if payload is None:
                                raise ValueError("the index points behind the records")
                            got[i] = unpack(payload)
                yield pa.RecordBatch.from_pydict({
                    "epoch_order": rows.column(0),
                    "doc_id": pa.array([d for d, _ in got], pa.int64()), "n_tokens": pa.array([len(x) for _, x in got], pa.int64()),
                    "ids": pa.array([x.tobytes() for _, x in got], pa.binary()),
                })

    n = manifest.sparkSession.sparkContext.defaultParallelism * 4
    index = manifest.select("shard", "path").repartition(n, "shard").mapInArrow(listed, "shard int, path string, record bigint, offset bigint")
    order = F.struct(F.xxhash64("shard", "record", F.lit(seed)).alias("draw"), "shard", "record").alias("epoch_order")
    drawn = index.select(order, "path", "offset").repartitionByRange("epoch_order").sortWithinPartitions("epoch_order")
    schema = "epoch_order struct<draw: bigint, shard: int, record: bigint>, doc_id bigint, n_tokens bigint, ids binary"
    return drawn.mapInArrow(fetch, schema)
