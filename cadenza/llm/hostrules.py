"""Quality rules at host level.

Every text is measured in one Arrow pass.  Rule failures are summed by host, and a host's failure rate is shrunk toward
the rate of all hosts with a beta prior fitted to the hosts' rates by their moments, so a host with few documents is not
judged by them alone.  A host whose shrunk rate of any rule exceeds `max_rate` is rejected, and its verdict is joined
back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.llm import textvec as tv
from cadenza.llm.arrow import add_columns
from cadenza.session import stored

#: Hosts up to this number (one narrow row each) are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 200_000
#: A prior's strength, in documents, stays within these bounds.
STRENGTH = (1.0, 10_000.0)

MEASURES = T.StructType([T.StructField(x, T.LongType()) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_CHARACTER = tv.NONSPACE & ((np.arange(256) & 0xC0) != 0x80)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key within its owner: is it there twice or more; and is it not the first in sorted order."""
    both = keys ^ tv.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(both, kind="stable")
    s = both[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    out, later = np.empty(len(s), bool), np.empty(len(s), bool)
    out[order], later[order] = twice, same
    return out, later


def measure_block(b: tv.Block, window: int = 5) -> dict[str, np.ndarray]:
    out = {"n_words": b.counts(), "word_chars": tv.sums(_CHARACTER[b.data], b.doc_start, b.doc_end), "n_symbols": tv.sums(_SYMBOL[b.data], b.doc_start, b.doc_end)}
    start, end, owner = b.lines()
    full = np.searchsorted(b.start, end) > np.searchsorted(b.start, start)
    start, end, owner = start[full], end[full], owner[full]
    _, later = _repeats(b.span_hashes(start, end, False), owner)
    out["n_dup_lines"] = np.bincount(owner[later], minlength=b.n)
    g, bounds = tv.shingles(b.hashes(fold=False), b.offsets, window)
    owner = np.repeat(np.arange(b.n), np.diff(bounds))
    twice, _ = _repeats(g, owner)
    first = b.offsets[owner[twice]] + np.flatnonzero(twice) - bounds[owner[twice]]
    edge = np.zeros(len(b.start) + window + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + window, -1)
    covered = np.cumsum(edge)[: len(b.start)] > 0
    out["n_repeat_words"] = np.bincount(b.owner()[covered], minlength=b.n)
    return out


def _measure(window: int):
    def run(arrays: list[pa.Array]) -> list[np.ndarray]:
        parts = [measure_block(b, window) for b in tv.blocks(arrays[0])]
        return [np.concatenate([p[f] for p in parts]) if parts else np.zeros(0, np.int64) for f in MEASURES.names]

    return run


def measures(docs: DataFrame, text_col: str = "text", window: int = 5, keep: list[str] | None = None) -> DataFrame:
    """docs' columns and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of the whole text (null: none)."""
    return add_columns(docs, [text_col], MEASURES, _measure, window, keep=keep)


def rules() -> dict[str, Column]:
    """A document's rule failures; the first two are the base rules, which reject it by themselves."""
    return {
        "short": F.expr("n_words < 10"),
        "repeated": F.expr("100 * n_repeat_words > 20 * n_words"),
        "symbols": F.expr("10 * n_symbols > word_chars"),
        "lines": F.expr("10 * n_dup_lines > n_words"),
    }


def host_verdicts(measured: DataFrame, host_col: str, max_rate: float) -> DataFrame:
    """(host, n_docs, <rule>_rate shrunk, host_kept) per host; a null host is a host."""
    names = list(rules())
    per = stored(measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(x).alias(k) for k, x in rules().items())), "hosts")
    r = {k: F.col(k) / F.col("n_docs") for k in names}
    fit = per.agg(*(F.avg(r[k]).alias(f"m_{k}") for k in names), *(F.var_pop(r[k]).alias(f"v_{k}") for k in names)).first()
    kept = F.lit(True)
    for k in names:
        m, v = fit[f"m_{k}"] or 0.0, fit[f"v_{k}"] or 0.0
        strength = min(max(m * (1 - m) / v - 1, STRENGTH[0]), STRENGTH[1]) if v > 0 else STRENGTH[1]
        per = per.withColumn(f"{k}_rate", (F.col(k) + F.lit(m * strength)) / (F.col("n_docs") + F.lit(strength)))
        kept = kept & (F.col(f"{k}_rate") <= max_rate)
    return stored(per.select("host", "n_docs", *(f"{k}_rate" for k in names), kept.alias("host_kept")), "verdicts")


def _judged(full: DataFrame, narrow: DataFrame, host_col: str, max_rate: float) -> DataFrame:
    """`full` with base_failed and kept, judged by the hosts of `narrow`; both are measured."""
    verdicts = host_verdicts(narrow, host_col, max_rate).select(F.col("host").alias("_host"), "host_kept")
    if verdicts.count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    base = rules()
    out = full.withColumn("base_failed", base["short"] | base["repeated"]).join(verdicts, F.col(host_col).eqNullSafe(F.col("_host")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))).drop("_host", "host_kept")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", *, max_rate: float = 0.5) -> DataFrame:
    """(id, the measures, base_failed, kept) per row.

    A null or empty text has no words and fails.  A null host is a host of its own.  Rows with equal ids are judged one
    by one; null ids come back.  Columns of docs other than these three are ignored.  An empty table gives an empty table.
    """
    rows = stored(measures(docs.select(id_col, text_col, host_col), text_col, keep=[id_col, host_col]), "measures")  # texts are read once
    return _judged(rows, rows, host_col, max_rate).drop(host_col)


def passing(docs: DataFrame, text_col: str = "text", host_col: str = "source", *, max_rate: float = 0.5) -> DataFrame:
    """The rows of docs that pass, with docs' columns; measures replace no column of docs.

    Texts are measured twice, for the hosts' verdicts and for their own, which costs less than to write them out between.
    """
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    text, host = (names[docs.columns.index(c)] for c in (text_col, host_col))
    return _judged(measures(plain, text, keep=names), measures(plain, text, keep=[host]), host, max_rate).where("kept").select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words FROM d JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT source, count(*) AS n, count(*) FILTER (n_words < 10) AS r0, count(*) FILTER (100 * n_repeat_words > 20 * n_words) AS r1,
      count(*) FILTER (10 * n_symbols > word_chars) AS r2, count(*) FILTER (10 * n_dup_lines > n_words) AS r3 FROM m GROUP BY source),
h AS (SELECT source, n, unnest([r0, r1, r2, r3]) AS r, unnest([0, 1, 2, 3]) AS k FROM f),
p AS (SELECT k, avg(r / n) AS mu, var_pop(r / n) AS v FROM h GROUP BY k),
s AS (SELECT k, mu, CASE WHEN v > 0 THEN least(greatest(mu * (1 - mu) / v - 1, 1.0), 10000.0) ELSE 10000.0 END AS z FROM p),
verdict AS (SELECT source, bool_and((r + mu * z) / (n + z) <= 0.5) AS ok FROM h JOIN s USING (k) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)) AND ok AS kept
FROM m JOIN verdict ON m.source IS NOT DISTINCT FROM verdict.source
"""
