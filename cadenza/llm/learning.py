"""Fitting a classifier in one task, on a bounded sample of labelled rows: only what it has learnt comes to the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import ship

#: Texts of the sample that are learnt from at most, in bytes; rows beyond it are left out whole.
MAX_BYTES = 128 << 20


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_rows: int, parts: int, part: int) -> DataFrame:
    """(id, text, y) of at most `max_rows` labelled documents, chosen by a hash of their id.

    None of them has crc32(id as text) mod `parts` equal to `part`.  Labels other than 0 and 1 and null ids are left out.
    Of several labels of one id the smallest counts, of several texts of one id the smallest, so reruns agree.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (F.crc32(F.col("id").cast("string")) % parts != part))
    known = known.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(known), "id")  # bounded by max_rows
    return rows.groupBy("id").agg(F.min("text").alias("text"), F.min("y").alias("y"))


def collected(rows: DataFrame) -> tuple[list[str | None], list[int]]:
    """Texts and labels of `labelled`, by id, in this process."""
    got = sorted(rows.collect(), key=lambda r: r.id)
    return [r.text for r in got], [r.y for r in got]


def learnt(rows: DataFrame, train: Callable[[list, list], bytes], max_bytes: int = MAX_BYTES) -> bytes:
    """train(texts, labels) of `labelled`, by id, run in one task; rows count by the hash of their id up to `max_bytes`."""
    ship(rows.sparkSession)

    def run(batches):
        import pyarrow as pa

        held, size = [], 0
        for batch in batches:
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "y")), strict=True):
                size += len((text or "").encode())
                if size > max_bytes and held:
                    break
                held.append((i, text, y))
            else:
                continue
            break
        held.sort(key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([train([r[1] for r in held], [r[2] for r in held])], pa.binary())], names=["model"])

    got = rows.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(run, "model binary").first()
    return bytes(got.model) if got else train([], [])
