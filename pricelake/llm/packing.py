"""Packing by power-of-two decomposition: binary-length pieces, equal lengths in one bucket."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text
from .tokens import encoder, text_slices

_SCHEMA = "doc_id bigint, start bigint, length bigint, bucket int, doc_tokens bigint, ids binary"


def binary_lengths(n: int, longest: int) -> list[int]:
    """``n`` as whole ``longest`` pieces and then the powers of two of the rest, falling."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << k for k in range(longest.bit_length() - 2, -1, -1) if rest >> k & 1]


def cut(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, start and length of each piece of documents with so many ``tokens``: `binary_lengths` of all at once."""
    bits = longest.bit_length() - 1
    whole, rest = tokens // longest, tokens % longest
    has = (rest[:, None] >> np.arange(bits - 1, -1, -1)) & 1
    counts = whole + has.sum(axis=1)
    doc = np.repeat(np.arange(len(tokens)), counts)
    place = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    length = np.full(len(doc), longest, np.int64)
    row, bit = np.nonzero(has)
    length[place >= whole[doc]] = (longest >> 1) >> bit  # both in order of document and falling length
    before = np.cumsum(length) - length
    first = np.cumsum(tokens) - tokens
    return doc, before - first[doc], length


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    seq_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row for each sequence: doc_id, start, length, bucket, doc_tokens, ids, sequence_id, offset.

    A document's ids and ``end_id`` are split into pieces whose lengths are
    powers of two up to ``seq_len``.  A piece is a whole sequence: `bucket` is
    the base-2 logarithm of its length, no sequence needs padding and none
    crosses documents.  `ids` holds little-endian unsigned 32-bit ids;
    `bucket_batches` brings equal lengths together.

    Nothing is shuffled.  `sequence_id` numbers the rows by partition and
    place, so ``docs`` should be a table that is read (a written one is read
    again in the same order after an executor is lost).

    Null or empty text: the end id alone, one piece of length 1.  Null ids pass
    through; repeated rows and ties are packed each.  Very long texts are cut
    into whole ``seq_len`` pieces one slice of rows at a time.  Other columns
    are ignored, whatever their names; an empty table gives an empty result.
    ``seq_len`` must be a power of two.
    """
    if seq_len & (seq_len - 1) or seq_len < 1:
        raise ValueError("seq_len must be a power of two")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for part in parts:
            for rows in text_slices(part):
                flat, bounds = enc.encode(rows.column(1), end_id)
                tokens = np.diff(bounds)
                doc, start, length = cut(tokens, seq_len)
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                ids = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(flat.astype("<u4"))])
                bucket = (np.frexp(length)[1] - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(bucket), pa.array(tokens[doc]), ids],
                    names=["doc_id", "start", "length", "bucket", "doc_tokens", "ids"],
                )

    pieces = id_text(docs, id_col, text_col).mapInArrow(run, _SCHEMA)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("bigint")})


def bucket_batches(sequences: DataFrame, batch_tokens: int = 1 << 18) -> DataFrame:
    """Training batches of equal lengths: bucket, batch, ids (all sequences of the batch in a row), sequences.

    A batch holds ``batch_tokens`` ids at most, so a bucket's sequences are
    dealt by a hash into as many cells as its ids fill, and a bucket with most
    of the corpus is many tasks.  Cells vary in size around the target; each
    is cut into batches of the exact bound, the last one of a cell shorter.
    Repeated rows count each; null document ids are ids like others; an empty
    table gives an empty result.
    """
    counts = sequences.groupBy("bucket").agg(F.sum("length").alias("tokens"))
    cells = F.broadcast(counts.select("bucket", F.ceil(F.col("tokens") / (64 * batch_tokens)).alias("cells")))
    dealt = sequences.join(cells, "bucket").withColumn("cell", F.pmod(F.xxhash64("doc_id", "start", "doc_tokens"), F.col("cells")))
    rows = dealt.select("bucket", "cell", F.crc32("ids").alias("tie"), "ids")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "cell", "batch", "ids", "sequences"]
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
        key, held, number = None, [], 0

        def batch() -> pa.RecordBatch:
            values = (*key, number, b"".join(held), len(held))
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for part in parts:
            for bucket, cell, raw in zip(*(part.column(i).to_pylist() for i in (0, 1, 3))):
                if key != (bucket, cell) or (len(held) + 1) << bucket > batch_tokens:
                    if held:
                        yield batch()
                    number = number + 1 if key == (bucket, cell) else 0
                    key, held = (bucket, cell), []
                held.append(raw)
        if held:
            yield batch()

    dealt = rows.repartition("bucket", "cell").sortWithinPartitions("bucket", "cell", "tie")
    return dealt.mapInArrow(run, "bucket int, cell bigint, batch bigint, ids binary, sequences bigint")
