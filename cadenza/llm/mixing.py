"""Mixing sources to target weights by systematic sampling.

A document's expected copies are its source's target over the source's size.  Within a source, documents stand in order
of size, their expected copies are summed up from the first, one random offset per source is added, and a document is
taken once for each integer that the sum crosses at it.  In that order the taken words differ from the target by about
the words of the largest document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.ranking import running_index
from cadenza.session import stored

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, ratio: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    The weights go to the sources in code point order, null last.  The sum of targets is `ratio` times all sizes; a target
    stops at `cap` times its source's size, and the excess goes to the others by weight until none is above.  Each round
    is one sum over the sources.
    """
    s = running_index(sizes, [], [F.col("source").asc_nulls_last()], "_rank")
    s = stored(s.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("double")), "weights")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    free, count = (0.0, 1.0), -1
    while True:
        over = F.lit(free[0]) * F.col("w") / F.lit(free[1]) > F.lit(cap) * F.col("source_size")
        if count < 0:
            over = F.lit(False)
        r = s.agg(F.count_if(over).alias("n"), F.sum(F.when(over, F.col("source_size")).otherwise(0)).alias("capped"), F.sum(F.when(over, 0.0).otherwise(F.col("w"))).alias("w")).first()
        if not r.w or r.n == count:
            break
        count, free = r.n, (ratio * total - cap * (r.capped or 0), r.w)
    share = F.lit(free[0]) * F.col("w") / F.lit(free[1])
    full = F.lit(cap) * F.col("source_size")
    return s.select("source", "source_size", F.when(share > full, full).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, ratio: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1), seed: int = 1) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) per document.

    Size is the number of words of the whole text (null: 0); taken = copies * size, and copies is at most `cap` rounded
    up.  Rows of one source with equal ids (null is an id) are one document of their joint size.  Reruns agree: the
    offset depends on the seed and the source's name only.  Other columns are ignored.  An empty table gives an empty one.
    """
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    unit = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words.alias("size"))
    unit = stored(unit.groupBy("id", "source").agg(F.sum("size").alias("size")), "units")
    goal = targets(unit.groupBy("source").agg(F.sum("size").alias("source_size")), ratio, cap, weights)
    named = F.concat(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")), F.lit(f"|{seed}"))
    u = F.conv(F.substring(F.md5(named), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    goal = goal.select(F.col("source").alias("_s"), "source_size", "target", rate.alias("rate"), u.alias("u"))
    placed = running_index(unit, ["source"], [F.col("size"), F.col("id").asc_nulls_first()], "i").join(goal, F.col("source").eqNullSafe(F.col("_s")))
    crossed = lambda i: F.floor(F.col("rate") * i + F.col("u"))
    out = placed.withColumn("copies", (crossed(F.col("i")) - crossed(F.col("i") - 1)).cast("long"))
    return out.select(F.col("id").alias(id_col), F.col("source").alias("source"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each row of docs, with all its columns, as many times as its document is taken."""
    plan = stored(mix_sources(docs, id_col, text_col, source_col, **how), "mix")
    plan = plan.where("copies > 0").select(F.col(id_col).alias("_id"), F.col("source").alias("_source"), "copies")
    names = [f"_{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    key, source = (F.col(names[docs.columns.index(c)]) for c in (id_col, source_col))
    # a row a document on either side: joined by a shuffle at every size, of which adaptive execution splits what is skewed
    plan = plan.hint("merge")
    d = d.join(plan, key.eqNullSafe(F.col("_id")) & source.eqNullSafe(F.col("_source")))
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*(F.col(a).alias(b) for a, b in zip(names, docs.columns, strict=True)))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')))::BIGINT AS size FROM documents GROUP BY doc_id, source),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
o AS (SELECT *, coalesce(sum(source_size) OVER before, 0) AS capped, sum(w) OVER after AS free, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE AS total FROM s
      WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
             after AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
level AS (SELECT capped, free, total FROM o WHERE (total - 2.0::DOUBLE * capped::DOUBLE) * w / free <= 2.0::DOUBLE * source_size ORDER BY free DESC, capped LIMIT 1),
t AS (SELECT source, source_size, least((level.total - 2.0::DOUBLE * level.capped::DOUBLE) * w / level.free, 2.0::DOUBLE * source_size) AS target,
      ('0x' || substr(md5(coalesce('s' || source, 'n') || '|1'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM o, level),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size::DOUBLE ELSE 0.0::DOUBLE END AS rate FROM t),
p AS (SELECT d.doc_id, d.source, size, row_number() OVER (PARTITION BY d.source ORDER BY size, d.doc_id NULLS FIRST) AS i FROM d),
c AS (SELECT doc_id, p.source, size, source_size, target, (floor(rate * i::DOUBLE + u) - floor(rate * (i - 1)::DOUBLE + u))::BIGINT AS copies FROM p JOIN r ON p.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
