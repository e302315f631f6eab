"""Packing by power-of-two decomposition.

Each document's ids (its end id last) are cut into as many pieces of ``most`` ids as fit and
then into one piece for each one bit of the rest, largest first. A piece is a sequence of its
own: its length is a power of two, so it needs no padding, and it never crosses documents.
Sequences are numbered bucket by bucket, so that those of one length stand together and a
trainer can draw batches of equal length by id ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orbis.llm.tokens import encoded
from orbis.session import checked_broadcast, materialize

PIECES = "part int, file string, row long, bucket int, rank long, doc_id long, start long, length long, doc_tokens long, ids binary"


def lengths(n: int, most: int) -> list[int]:
    """The pieces of a document of n ids: whole sequences, then the binary digits of the rest."""
    whole, rest = divmod(n, most)
    return [most] * whole + [1 << b for b in reversed(range(most.bit_length() - 1)) if rest >> b & 1]


def pack(docs: DataFrame, *, tokenizer: str | None = None, end_id: int = 1, most: int = 2048, in_file_order: bool = False) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, bucket, ids.

    ``most`` is a power of two. ids are little-endian u32. A null text counts as empty and
    gives one piece with the end id. Rows that share a doc_id, null ones too, are packed each
    on its own. An empty table gives no rows; columns other than doc_id and text are ignored.
    No text is shuffled: pieces are written where they are made, and only a count for each
    write task, file and bucket is gathered to number the sequences. With in_file_order, docs are
    freshly read files, and within each bucket sequences follow the order of files and rows.
    """
    if most & (most - 1) or most < 1:
        raise ValueError("most must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        at: list = [None, 0]  # the file read now, and the first row of this task in it
        ranks = [0] * most.bit_length()
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
            names = ["part", "file", "row", "bucket", "rank", "doc_id", "start", "length", "doc_tokens", "ids"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        def placed() -> Iterator[tuple]:
            for b in batches:
                yield from zip(b.column(2).to_pylist(), b.column(3).to_pylist(), encoded([b], tokenizer, end_id))

        for file, row, (doc_id, ids) in placed():
            if file != at[0]:
                at, ranks = [file, row], [0] * most.bit_length()
            wide, start, n = ids.astype("<u4").tobytes(), 0, len(ids)
            for length in lengths(n, most):
                bucket = length.bit_length() - 1
                rows.append((part, *at, bucket, ranks[bucket], doc_id, start, length, n, wide[4 * start : 4 * (start + length)]))
                ranks[bucket] += 1
                start += length
            size += n
            if size > 500_000:
                yield flush()
                rows, size = [], 0
        if rows:
            yield flush()

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    where = ("_metadata.file_name", "_metadata.row_index") if in_file_order else (F.lit(""), F.lit(0).cast("long"))
    pieces = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, *where).mapInArrow(cut, PIECES), "pieces")
    counts = pieces.groupBy("bucket", "part", "file", "row").agg(F.count("*").alias("n"))
    total = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("n")).select("bucket", F.coalesce(F.sum("n").over(total), F.lit(0)).alias("first"))
    within = Window.partitionBy("bucket").orderBy("file", "row", "part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("bucket", "part", "file", "row", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("before")).join(F.broadcast(buckets), "bucket")
    numbered = pieces.join(checked_broadcast(bases.select("bucket", "part", "file", "row", (F.col("first") + F.col("before")).alias("base")), counts.count()), ["bucket", "part", "file", "row"])
    return numbered.select("doc_id", "start", "length", "doc_tokens", (F.col("base") + F.col("rank")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", "ids")
