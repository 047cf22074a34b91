"""Harmonic packing of token sequences.

Class k holds the pieces whose length lies in (capacity / (k + 1), capacity / k], and each of its bins takes exactly k of
them, so a piece's bin follows from its number in its class: workers need nothing from each other but how many pieces of
a class come before theirs.  Documents are cut so that classes are filled without waste: whole bins first, then the
slots capacity / 2, / 4, ... down to `tail` tokens, which halve the remainder exactly, and one tail piece shorter than
that.  All pieces of one length share a class, so every full bin wastes less than one piece of at most `tail` tokens.
The last, unfinished bins (of `tail` plus a few classes, a number that doesn't grow with the data) are put together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrow import trimmed
from cadenza.llm.ranking import running_index
from cadenza.llm.tokens import END_ID, TOKENIZER, crc, encoder, tokenizer_path
from cadenza.session import ship, stored

CAPACITY = 2048
TAIL = 32


def cuts(n: int, capacity: int = CAPACITY, tail: int = TAIL) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (n // capacity)
    rest, slot = n % capacity, capacity // 2
    while slot >= tail and rest:
        if rest >= slot:
            out.append(slot)
            rest -= slot
        slot //= 2
    return [*out, rest] if rest else out


def _pieces(tokenizer: str, end_id: int, capacity: int, tail: int, with_ids: bool):
    def run(batches):
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            row, start, length, digest, total, ids = [], [], [], [], [], []
            for i, doc in enumerate(enc.encode(batch.column(1))):
                at, view = 0, memoryview(doc)
                for n in cuts(len(doc) // 4, capacity, tail):
                    part = view[4 * at : 4 * (at + n)]
                    row.append(i)
                    start.append(at)
                    length.append(n)
                    digest.append(crc(part))
                    total.append(len(doc) // 4)
                    if with_ids:
                        ids.append(bytes(part))
                    at += n
            out = [batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, digest, total))]
            yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * with_ids, names=["id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    return run


def _leftovers(capacity: int):
    """Put the pieces of unfinished bins together, the longest first, each into the first bin that has room."""

    def run(pdf):
        pdf = pdf.sort_values(["length", "i"], ascending=[False, True]).reset_index(drop=True)
        free: list[int] = []
        where, offset = [], []
        low, now = 0, None
        for n in pdf["length"].tolist():
            if n != now:
                low, now = 0, n
            while low < len(free) and free[low] < n:
                low += 1
            if low == len(free):
                free.append(capacity)
            where.append(low)
            offset.append(capacity - free[low])
            free[low] -= n
        pdf["bin"] = np.array(where, np.int64)
        pdf["offset"] = np.array(offset, np.int64)
        return pdf[["length", "i", "bin", "offset"]]

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, tail: int = TAIL, tokenizer: str | None = None, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) per piece.

    A null or empty text is its end id only.  Rows with equal ids (null is an id) are separate documents, each with pieces
    of its own.  Other columns are ignored.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if with_ids else "")
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # written first: dealing rows out by ranges reads them twice
    pieces = stored(d.mapInArrow(trimmed(_pieces(tokenizer or tokenizer_path(TOKENIZER), end_id, capacity, tail, with_ids)), schema), "cut")
    order = [F.col("id").asc_nulls_first(), F.col("start"), F.col("ids_crc32")]
    pieces = stored(running_index(pieces, ["length"], order, "i").withColumn("i", F.col("i") - 1), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity's log2 + tail lengths at most
    base, full, at = {}, {}, 0
    for n in sorted(counts, reverse=True):
        k = capacity // n
        base[n], full[n] = at, counts[n] // k * k
        at += counts[n] // k
    if not counts:
        base, full = {capacity: 0}, {capacity: 0}
    look = lambda m: F.create_map(*(F.lit(x).cast("long") for kv in m.items() for x in kv))[F.col("length")]
    k = F.floor(F.lit(capacity) / F.col("length")).cast("long")
    filled = pieces.where(F.col("i") < look(full)).withColumn("sequence_id", look(base) + F.floor(F.col("i") / k)).withColumn("offset", F.col("i") % k * F.col("length"))
    rest = pieces.where(F.col("i") >= look(full))
    placed = rest.select("length", "i", F.lit(0).alias("all")).groupBy("all").applyInPandas(_leftovers(capacity), "length long, i long, bin long, offset long")
    rest = rest.join(F.broadcast(placed), ["length", "i"]).withColumn("sequence_id", F.lit(at).cast("long") + F.col("bin"))
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    return filled.select("id", *names).unionByName(rest.select("id", *names)).withColumnRenamed("id", id_col)


def sequences(packed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids, pieces): each sequence's ids without padding, from `pack(..., with_ids=True)`; at most capacity ids a row."""
    part = F.struct("offset", "length", id_col, "start", "ids")
    s = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    ids = F.concat_ws("", F.transform("p", lambda x: F.hex(x["ids"])))
    return s.select("sequence_id", F.unhex(ids).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("pieces"))
