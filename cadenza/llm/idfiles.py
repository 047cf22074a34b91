"""Token ids in files: frequency-ranked ids in a byte-aligned code, its control bytes apart from its data bytes.

A file holds consecutive documents in ascending order of id.  All numbers are little-endian.

    8 bytes   magic
    3 * 8     numbers of documents D, of ids N, of distinct ids R
    R * 4     the distinct ids, the file's most frequent first (ties: the smaller first): position = rank
    D * 8     document ids;  D * 1  1 where the document id is null;  D * 8  ids per document
    N/4       control bytes: 2 bits per id, from the lowest up, are the bytes of its rank less 1
    rest      data bytes: each rank's 1 to 4 low bytes

The ranks are a file's own, so that one pass over the texts is enough and each file can be read by itself; that costs a
list of the file's distinct ids, 4 bytes each, which is at most 49k ids of 4 million or more.  A reader looks control bytes
up in a table of 256 rows of four lengths, and sums these to find where each rank starts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cadenza.llm.arrow import trimmed
from cadenza.llm.files import get, put
from cadenza.llm.tokens import END_ID, TOKENIZER, crc, encoder, tokenizer_path
from cadenza.session import scratch, ship, stored

MAGIC = b"CDZIDS01"
#: A file is closed at so many ids, or after one longer document.
FILE_IDS = 4 << 20
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def pack(doc_ids: list[int | None], docs: list[bytes]) -> bytes:
    ids = np.frombuffer(b"".join(docs), "<u4")
    size = np.array([len(d) // 4 for d in docs], "<u8")
    if len(ids):
        top = int(ids.max()) + 1
        if top <= 1 << 24:
            count = np.bincount(ids, minlength=top)
            distinct = np.flatnonzero(count)
            distinct = distinct[np.argsort(-count[distinct], kind="stable")]
            rank_of = np.zeros(top, np.uint32)
            rank_of[distinct] = np.arange(len(distinct), dtype=np.uint32)
            rank = rank_of[ids]
        else:
            u, inverse, count = np.unique(ids, return_inverse=True, return_counts=True)
            order = np.argsort(-count, kind="stable")
            place = np.empty(len(u), np.uint32)
            place[order] = np.arange(len(u), dtype=np.uint32)
            distinct, rank = u[order], place[inverse]
    else:
        distinct, rank = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
    n = len(rank)
    length = (1 + (rank > 0xFF) + (rank > 0xFFFF) + (rank > 0xFFFFFF)).astype(np.uint8)
    padded = np.zeros(-(-n // 4) * 4, np.uint8)
    padded[:n] = length - 1
    control = (padded.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(length, out=at[1:])
    data = np.zeros(int(at[-1]), np.uint8)
    for k in range(int(length.max()) if n else 0):
        m = length > k if k else slice(None)
        data[at[:-1][m] + k] = (rank[m] >> np.uint32(8 * k)).astype(np.uint8)
    head = np.array([len(docs), n, len(distinct)], "<u8").tobytes()
    names = np.array([0 if x is None else x for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, distinct.astype("<u4").tobytes(), names, size.tobytes(), control.tobytes(), data.tobytes()])


def unpack(content: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids of a file."""
    if content[:8] != MAGIC:
        raise ValueError("not a token id file")
    d, n, r = (int(x) for x in np.frombuffer(content, "<u8", 3, 8))
    at = 32
    distinct = np.frombuffer(content, "<u4", r, at)
    at += 4 * r
    names = np.frombuffer(content, "<i8", d, at)
    null = np.frombuffer(content, np.uint8, d, at + 8 * d)
    size = np.frombuffer(content, "<u8", d, at + 9 * d).astype(np.int64)
    at += 17 * d
    control = np.frombuffer(content, np.uint8, -(-n // 4), at)
    data = np.frombuffer(content, np.uint8, -1, at + len(control)) if n else np.zeros(0, np.uint8)
    length = LENGTHS[control].reshape(-1)[:n]
    start = np.zeros(n + 1, np.int64)
    np.cumsum(length, out=start[1:])
    if start[-1] != len(data) or size.sum() != n:
        raise ValueError("damaged token id file")
    rank = data[start[:-1]].astype(np.uint32)
    for k in range(1, int(length.max()) if n else 0):
        m = np.flatnonzero(length > k)
        rank[m] |= data[start[:-1][m] + k].astype(np.uint32) << np.uint32(8 * k)
    return [None if z else int(x) for x, z in zip(names, null, strict=True)], size, distinct[rank] if n else np.zeros(0, np.uint32)


def _writer(folder: str, tokenizer: str, end_id: int | None, most: int):
    def run(batches):
        enc, part, held, names, total, k = encoder(tokenizer, end_id), TaskContext.get().partitionId(), [], [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"ids-{part:06d}-{k:06d}.bin"
            put(folder, name, pack(names, held))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([total], pa.int64())], names=["name", "part", "seq", "n_docs", "n_ids"])

        for batch in batches:
            for doc, ids in zip(batch.column(0), enc.encode(batch.column(1)), strict=True):
                names.append(doc.as_py())
                held.append(ids)
                total += len(ids) // 4
                if total >= most:
                    yield close()
                    held, names, total, k = [], [], 0, k + 1
        if held:
            yield close()

    return run


def write_ids(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", *, tokenizer: str | None = None, end_id: int | None = END_ID, file_ids: int = FILE_IDS) -> DataFrame:
    """Encode every whole text and write the ids to `folder`, which driver and executors share, in ascending order of id.

    Returns the manifest: (name, start, n_docs, n_ids) per file, start being the ids in all files before it.  A null text
    is empty and gets the end id only; null ids come first; rows with equal ids are separate documents in any order.
    Other columns are ignored.  An empty table makes no file.
    """
    ship(docs.sparkSession)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("id").asc_nulls_first(), F.xxhash64("text")  # so that rows of one id, or without one, are dealt out, too
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).repartitionByRange(n, *order).sortWithinPartitions(*order).select("id", "text")
    made = stored(d.mapInArrow(trimmed(_writer(folder, tokenizer or tokenizer_path(TOKENIZER), end_id, file_ids)), "name string, part int, seq int, n_docs long, n_ids long"), "manifest")
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return made.select("name", before.alias("start"), "n_docs", "n_ids")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _reader(folder: str, digest: bool):
    schema = READ.remove(3).append(pa.field("ids_crc32", pa.int64())) if digest else READ

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                names, size, ids = unpack(get(folder, name))
                end = np.cumsum(size)
                parts = [ids[a:b] for a, b in zip((end - size).tolist(), end.tolist(), strict=True)]
                last = pa.array([crc(x) for x in parts] if digest else [x.astype("<u4").tobytes() for x in parts], schema.field(3).type)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(base + end - size), pa.array(size), last], schema=schema)

    return run


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame, *, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids) per document, read back from the files; `digest` gives ids_crc32 in place of ids.

    Tasks get names and open the files themselves, one at a time.  `ids` are little-endian unsigned 32-bit integers.
    """
    ship(spark)
    last = "ids_crc32 long" if digest else "ids binary"
    schema = f"doc_id long, start long, n_tokens long, {last}"
    if manifest.isEmpty():
        return spark.createDataFrame([], schema)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("name", "start").repartition(n, "name").mapInArrow(_reader(folder, digest), schema)


def id_file_digests(docs: DataFrame, **how) -> DataFrame:
    """Write, read back, and return (doc_id, start, n_tokens, ids_crc32) per document, from the files."""
    spark = docs.sparkSession
    folder = scratch(spark, "ids")
    return read_ids(spark, folder, write_ids(docs, folder, **how), digest=True)
