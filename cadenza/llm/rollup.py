"""Token counts: rollups by source, language and tokenizer version, maintained by signed deltas.

A rollup lives in a folder of the shared store:

    state/<attempt>    the changed documents' counts after a batch, and whether each is still there
    deltas/<attempt>   what a batch adds to each (source, lang, tokenizer): documents and tokens, negative for what it removes
    log/<place>        made last, whole and only if the place is free: the batch's name and its attempt

A change of a document subtracts what its last committed state had added and adds its new counts, so totals are sums of
deltas and no batch reads the texts of another.  What an attempt has written before its commit is not seen.  A batch that
is committed is not applied again.  Of two writers that start from one log, the place goes to one; the other starts again
from the log that has it.

A compaction is an entry of the log, too: it stands for all entries before it, with the states of live documents and the
totals.  It is made after `every` batches, so a batch reads a bounded number of folders however long the history is, and of
the states only the rows of its own documents are shuffled.
"""

from __future__ import annotations

import json
import os
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textvec as tv
from cadenza.llm.arrow import add_columns
from cadenza.llm.tokens import TOKENIZER, encoder, tokenizer_path
from cadenza.session import scratch, stored

#: Tokenizer versions: runs of characters outside ASCII white space, and a public BPE file's ids.
TOKENIZERS = ("words-1", "word_bpe_49k-1")
STATE = "doc_id long, tokenizer string, source string, lang string, n_tokens long, live boolean"
DELTA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _counter(names: tuple[str, ...], path: str):
    def run(arrays: list[pa.Array]) -> list:
        out = []
        for name in names:
            if name == "words-1":
                out.append([int(n) for b in tv.blocks(arrays[0]) for n in b.counts()])
            elif name == "word_bpe_49k-1":
                out.append([len(x) // 4 for x in encoder(path, None).encode(arrays[0])])
            else:
                raise ValueError(f"unknown tokenizer {name}")
        return [pa.array(x, pa.int64()) for x in out]

    return run


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", *, tokenizers: tuple[str, ...] = TOKENIZERS, path: str | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): one row per document and tokenizer; a null text has 0 tokens."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    fields = T.StructType([T.StructField(f"n{i}", T.LongType()) for i in range(len(tokenizers))])
    d = add_columns(d, ["text"], fields, _counter, tokenizers, path or tokenizer_path(TOKENIZER), keep=["doc_id", "source", "lang"])
    pairs = F.array(*(F.struct(F.lit(t).alias("tokenizer"), F.col(f"n{i}").alias("n_tokens")) for i, t in enumerate(tokenizers)))
    return d.select("doc_id", "source", "lang", F.explode(pairs).alias("x")).select("doc_id", "source", "lang", "x.*")


class Rollup:
    def __init__(self, spark: SparkSession, folder: str, every: int = 16):
        self.spark, self.folder, self.every = spark, folder.rstrip("/"), every

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _places(self) -> list[int]:
        fs, p = self._fs(f"{self.folder}/log")
        return sorted(int(name) for s in fs.listStatus(p) if (name := s.getPath().getName()).isdigit()) if fs.exists(p) else []

    def _entry(self, place: int) -> dict:
        fs, p = self._fs(f"{self.folder}/log/{place:09d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode())
        finally:
            stream.close()

    def _log(self) -> tuple[int, list[dict], dict[str, int]]:
        """The last place, the entries from the last compaction on, and all committed batches with their places."""
        places, entries = self._places(), []
        for place in reversed(places):
            entries.insert(0, self._entry(place) | {"place": place})
            if "batches" in entries[0]:
                break
        names = dict(entries[0].get("batches", {})) if entries else {}
        return places[-1] if places else 0, entries, names | {e["batch"]: e["place"] for e in entries if "batch" in e}

    def _commit(self, place: int, entry: dict) -> bool:
        """Put an entry at its place, whole; False if another has it.  The store's rename must not replace a file."""
        fs, folder = self._fs(f"{self.folder}/log")
        fs.mkdirs(folder)
        part, final = (self._fs(f"{self.folder}/log/{x}")[1] for x in (f"_{uuid.uuid4().hex}", f"{place:09d}"))
        stream = fs.create(part, False)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":  # whose rename replaces files; a hard link doesn't
                os.link(part.toUri().getPath(), final.toUri().getPath())
                return True
            return not fs.exists(final) and fs.rename(part, final)
        except FileExistsError:
            return False
        finally:
            fs.delete(part, False)

    def committed(self) -> dict[str, int]:
        """Committed batches and their places."""
        return self._log()[2]

    def _read(self, kind: str, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{kind}/{n}" for n in names))

    def _latest(self, entries: list[dict], changed: DataFrame | None = None) -> DataFrame:
        """The last committed state of every document and tokenizer, or of the documents in `changed` (doc_id)."""
        parts = [self._read("state", [e["at"]], STATE).withColumn("at", F.lit(e["place"])) for e in entries]
        if not parts:
            return self._read("state", [], STATE)
        rows = reduce(DataFrame.unionByName, parts)
        if changed is not None:
            ids = changed.select(F.col("doc_id").alias("c_id")).distinct()
            rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("c_id")), "left_semi")
        last = rows.groupBy("doc_id", "tokenizer").agg(F.max_by(F.struct("source", "lang", "n_tokens", "live"), "at").alias("s"))
        return last.select("doc_id", "tokenizer", "s.*")

    def apply(self, batch: str, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> bool:
        """Apply a batch once: False if it is committed already.

        `upserts` has the columns of `counted`: new documents and revised counts.  `deletes` has doc_id and, optionally,
        tokenizer (else the document goes from all).  Deleting what isn't there changes nothing.  Of several rows of one
        document and tokenizer in a batch, the one that comes last by (source, lang, n_tokens) counts, and an upsert wins
        over a delete.  A null id is an id; null sources and languages are groups.
        """
        if not batch or "/" in batch:
            raise ValueError("a batch needs a name without /")
        while True:
            last, entries, done = self._log()
            if batch in done:
                return False
            at = f"{batch}-{uuid.uuid4().hex[:12]}"
            self._write(at, entries, upserts, deletes)
            if self._commit(last + 1, {"batch": batch, "at": at}):
                break
            for kind in ("state", "deltas"):  # another writer was first: what was written is of no use
                fs, p = self._fs(f"{self.folder}/{kind}/{at}")
                fs.delete(p, True)
        if len(entries) + 1 >= self.every:
            self.compact()
        return True

    def _write(self, at: str, entries: list[dict], upserts: DataFrame | None, deletes: DataFrame | None) -> None:
        changed = [x.select("doc_id") for x in (upserts, deletes) if x is not None]
        old = self._latest(entries, reduce(DataFrame.unionByName, changed) if changed else None).withColumnsRenamed({c: f"o_{c}" for c in ("doc_id", "tokenizer", "source", "lang", "n_tokens", "live")})
        new = []
        if upserts is not None:
            new.append(upserts.select("doc_id", "tokenizer", "source", "lang", "n_tokens", F.lit(True).alias("live")))
        if deletes is not None:
            gone = deletes.select(F.col("doc_id").alias("d_id"), *([F.col("tokenizer").alias("d_tok")] if "tokenizer" in deletes.columns else [])).distinct()
            same = F.col("o_doc_id").eqNullSafe(F.col("d_id"))
            if "d_tok" in gone.columns:
                same &= F.col("o_tokenizer") == F.col("d_tok")
            gone = old.join(gone, same, "left_semi")
            new.append(gone.select(F.col("o_doc_id").alias("doc_id"), F.col("o_tokenizer").alias("tokenizer"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("lang"), F.lit(0).cast("long").alias("n_tokens"), F.lit(False).alias("live")))
        if not new:
            new = [self._read("state", [], STATE)]
        rows = reduce(DataFrame.unionByName, new).groupBy("doc_id", "tokenizer").agg(F.max(F.struct("live", "source", "lang", "n_tokens")).alias("s"))
        rows = rows.select("doc_id", "tokenizer", "s.source", "s.lang", "s.n_tokens", "s.live")
        state = f"{self.folder}/state/{at}"
        rows.write.mode("overwrite").parquet(state)
        rows = self.spark.read.schema(STATE).parquet(state)
        plus = rows.where("live").select("source", "lang", "tokenizer", F.lit(1).alias("d"), "n_tokens")
        parts = [plus]
        if entries:
            was = old.where("o_live").join(rows.select("doc_id", "tokenizer"), F.col("o_doc_id").eqNullSafe(F.col("doc_id")) & (F.col("o_tokenizer") == F.col("tokenizer")), "left_semi")
            parts.append(was.select(F.col("o_source").alias("source"), F.col("o_lang").alias("lang"), F.col("o_tokenizer").alias("tokenizer"), F.lit(-1).alias("d"), (-F.col("o_n_tokens")).alias("n_tokens")))
        delta = reduce(DataFrame.unionByName, parts).groupBy("source", "lang", "tokenizer").agg(F.sum("d").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens"))
        delta.where("n_docs != 0 or n_tokens != 0").write.mode("overwrite").parquet(f"{self.folder}/deltas/{at}")

    def compact(self) -> bool:
        """Put one entry in place of all so far; False if another writer was first, or there is nothing to do."""
        last, entries, done = self._log()
        if not entries or (len(entries) == 1 and "batches" in entries[0]):
            return False
        at = f"compact-{uuid.uuid4().hex[:12]}"
        self._latest(entries).where("live").write.parquet(f"{self.folder}/state/{at}")
        self._sum(entries).write.parquet(f"{self.folder}/deltas/{at}")
        return self._commit(last + 1, {"batches": done, "at": at})

    def vacuum(self) -> None:
        """Delete what no entry from the last compaction on needs.  Nobody may be reading or writing the rollup meanwhile."""
        last, entries, _ = self._log()
        used = {e["at"] for e in entries}
        for kind in ("state", "deltas"):
            fs, p = self._fs(f"{self.folder}/{kind}")
            for s in fs.listStatus(p) if fs.exists(p) else []:
                if s.getPath().getName() not in used:
                    fs.delete(s.getPath(), True)

    def _sum(self, entries: list[dict]) -> DataFrame:
        d = self._read("deltas", [e["at"] for e in entries], DELTA)
        return d.groupBy("source", "lang", "tokenizer").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).where("n_docs != 0 or n_tokens != 0")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens): the sum of all committed deltas, without groups that are empty."""
        return self._sum(self._log()[1])


def keyed(counts: DataFrame) -> DataFrame:
    """`counts`, in which each row without an id has one of its own, below all that are there (and below 0)."""
    low = counts.agg(F.least(F.min("doc_id"), F.lit(0)), F.count(F.when(F.col("doc_id").isNull(), 1))).first()
    if not low[1]:
        return counts
    own = F.lit(low[0] - 1) - F.monotonically_increasing_id()
    return stored(counts.withColumn("doc_id", F.coalesce("doc_id", own)), "keyed")  # written, so each batch has the same ids


def token_counts(docs: DataFrame, **how) -> DataFrame:
    """Totals of a new rollup of all of `docs` in four batches, each sent twice, as by a job that runs again.

    They are: all documents, with one token too many; their counts revised; all documents deleted; and all put back.  Rows
    without an id are documents of their own; of several rows of one id, one counts, as in apply().
    """
    r = Rollup(docs.sparkSession, scratch(docs.sparkSession, "rollup"))
    counts = keyed(stored(counted(docs, **how), "counts"))
    batches = {
        "documents": (counts.withColumn("n_tokens", F.col("n_tokens") + 1), None),
        "revised": (counts, None),
        "deleted": (None, counts.select("doc_id")),
        "reinserted": (counts, None),
    }
    for name, (upserts, deletes) in batches.items():
        for _ in range(2):
            r.apply(name, upserts, deletes)
    return r.totals()
