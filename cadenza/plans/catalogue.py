"""Registered queries of the library engine's operators over the supplied tables, and the SQL that must agree.

embeddings stand for sample buffers, documents.n_chars for sample counts, pages.url and part.p_name for paths, events for
the log of a run, orders and lineitem for listings.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.functions import arrays, keys, paths
from cadenza.operators import detect, tracks
from cadenza.session import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _round(c, n: int = 5):
    return F.round(c, n) + 0.0


def _cells(df: DataFrame, *keep: str, value: str = "x") -> DataFrame:
    """One row per array element."""
    return df.select(*keep, F.posexplode(value).alias("pos", "value")).select(*keep, "pos", _round(F.col("value")).alias("value"))


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as a music folder: by key, one of seven endings."""
    ends = F.array(*map(F.lit, [".mp3", ".WAV", ".flac", ".aif", ".txt", "", ".Aiff"]))
    p = read(spark, sf, "part")
    path = F.concat(F.lit("/m/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.element_at(ends, (F.col("p_partkey") % 7 + 1).cast("int")))
    return p.select("p_partkey", path.alias("path"), F.col("p_size").alias("size_bytes"))


_SQL_FILES = """(SELECT p_partkey, '/m/' || p_brand || '/' || p_name || (['.mp3', '.WAV', '.flac', '.aif', '.txt', '', '.Aiff'])[p_partkey % 7 + 1] AS path, p_size AS size_bytes FROM part)"""
_SQL_E = "(SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings)"


def _sql_cells(inner: str, keep: str = "vec_id") -> str:
    return f"SELECT {keep}, (i - 1)::INT AS pos, round(x[i], 5) + 0.0::DOUBLE AS value FROM (SELECT {keep}, x, unnest(range(1, len(x) + 1)) AS i FROM ({inner}))"


def _sql_fnv(n: str) -> str:
    b = f"list_transform(range(1, octet_length(encode({n})) + 1), lambda i: ('0x' || hex(encode({n}))[2 * i - 1 : 2 * i])::BIGINT)"
    return f"(list_reduce({b}, lambda h, v: ((xor(h, v) * 16777619) & 4294967295), 2166136261::BIGINT) & 2147483647)::INT"


@query(f"""SELECT kind, path, {_sql_fnv("lower(replace(path, chr(92), '/'))")} AS track_id FROM
    (SELECT 'url' AS kind, url AS path FROM pages UNION ALL SELECT 'part', p_name FROM part UNION ALL SELECT 'win', 'C:\\Music\\' || p_name FROM part)""")
def track_id_fnv1a(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part")
    p = read(spark, sf, "pages").select(F.lit("url").alias("kind"), F.col("url").alias("path"))
    p = p.union(part.select(F.lit("part"), "p_name")).union(part.select(F.lit("win"), F.concat(F.lit("C:\\Music\\"), "p_name")))
    return p.withColumn("track_id", paths.track_id(F.col("path")))


@query("""WITH p AS (SELECT path, CASE WHEN regexp_matches(path, '^[A-Za-z]:') THEN '/' || replace(path, chr(92), '/') ELSE replace(path, chr(92), '/') END AS q
      FROM (SELECT DISTINCT url AS path FROM pages UNION SELECT 'C:\\My Music\\' || text || '#1.mp3' FROM (SELECT DISTINCT left(text, 40) AS text FROM documents)))
    SELECT path, 'file://localhost' || array_to_string(list_transform(range(1, octet_length(encode(q)) + 1), lambda i: CASE
      WHEN ('0x' || hex(encode(q))[2 * i - 1 : 2 * i])::INT NOT BETWEEN 32 AND 126 OR ('0x' || hex(encode(q))[2 * i - 1 : 2 * i])::INT IN (32, 34, 35, 37, 38, 39, 60, 62, 63, 91, 93, 94, 96, 123, 124, 125)
      THEN '%' || hex(encode(q))[2 * i - 1 : 2 * i] ELSE chr(('0x' || hex(encode(q))[2 * i - 1 : 2 * i])::INT) END), '') AS uri FROM p""")
def location_uri(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select(F.col("url").alias("path"))
    d = read(spark, sf, "documents").select(F.concat(F.lit("C:\\My Music\\"), F.left("text", F.lit(40)), F.lit("#1.mp3")))
    return p.union(d).distinct().withColumn("uri", paths.location_uri(F.col("path")))


@query()
def location_uri_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts as paths, a row per document; location_uri has prefixes, as its SQL has."""
    d = read(spark, sf, "documents").select("doc_id", F.concat(F.lit("C:\\My Music\\"), "text", F.lit("#1.mp3")).alias("path"))
    return d.withColumn("uri", paths.location_uri(F.col("path")))


@query(f"""SELECT path, CASE lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) WHEN 'mp3' THEN 'mp3' WHEN 'wav' THEN 'wav' WHEN 'flac' THEN 'flac' ELSE 'aiff' END AS format, size_bytes
    FROM {_SQL_FILES} WHERE lower(regexp_extract(path, '[^/][.]([^./]+)$', 1)) IN ('mp3', 'wav', 'flac', 'aiff', 'aif')""")
def format_filter(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.discover(_files(spark, sf))


@query(f"""SELECT path, regexp_extract(path, '([^/]+?)([.][^./]*)?$', 1) AS title FROM {_SQL_FILES}""")
def title_fallback(spark: SparkSession, sf: str) -> DataFrame:
    f = _files(spark, sf)
    return f.select("path", paths.title(F.lit(None).cast("string"), F.col("path")).alias("title"))


@query(f"""SELECT upper(CASE WHEN e = '' THEN 'unknown' ELSE e END) AS format, count(*) AS n FROM (SELECT regexp_extract(path, '[^/][.]([^./]+)$', 1) AS e FROM {_SQL_FILES}) GROUP BY 1""")
def dry_run_by_format(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.by_format(_files(spark, sf))


@query(f"""SELECT regexp_replace(path, '/[^/]*$', '') AS dir, count(*) AS n, min(regexp_extract(path, '([^/]*)$', 1)) AS first_name, max(regexp_extract(path, '([^/]*)$', 1)) AS last_name FROM {_SQL_FILES} GROUP BY 1""")
def dry_run_by_directory(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.by_directory(_files(spark, sf))


@query("""SELECT count(*) AS files, format('{}m {}s', (count(*) * 3) // 60, (count(*) * 3) % 60) AS eta FROM part""")
def dry_run_eta(spark: SparkSession, sf: str) -> DataFrame:
    return _files(spark, sf).agg(F.count("*").alias("files")).withColumn("eta", tracks.eta_text(F.col("files")))


def _listing(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), "o_totalprice"), read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"))


@query("SELECT o_orderkey AS path, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def incremental_pending(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.pending(*_listing(spark, sf))


@query("SELECT o_orderkey AS path, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def incremental_done(spark: SparkSession, sf: str) -> DataFrame:
    return tracks.already_done(*_listing(spark, sf))


@query("""SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN
    (SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F') WHERE r = 1) ON o_custkey = c_custkey""")
def stem_merge(spark: SparkSession, sf: str) -> DataFrame:
    stems = read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return tracks.merge_stems(read(spark, sf, "customer").select("c_custkey", "c_name"), stems, "c_custkey", "o_orderkey")


@query("""SELECT count(*) + 7 AS total, count(*) FILTER (k IS NULL) AS successful, count(*) FILTER (k = 'output') AS failed, count(*) FILTER (k IN ('decode', 'analysis')) + 7 AS skipped
    FROM (SELECT CASE event_type WHEN 'error' THEN 'decode' WHEN 'signup' THEN 'analysis' WHEN 'purchase' THEN 'output' END AS k FROM events)""")
def outcome_counters(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("event_type")
    kind = F.when(t == "error", "decode").when(t == "signup", "analysis").when(t == "purchase", "output")
    return tracks.outcome_counts(read(spark, sf, "events").select(kind.alias("error_kind")), existing=7)


# The wheel's codes by pitch class, major and minor.
_SQL_WHEEL = """(SELECT p, n, major, minor FROM (VALUES
    (0, 'C', 8, 5), (1, 'C#', 3, 12), (2, 'D', 10, 7), (3, 'D#', 5, 2), (4, 'E', 12, 9), (5, 'F', 7, 4),
    (6, 'F#', 2, 11), (7, 'G', 9, 6), (8, 'G#', 4, 1), (9, 'A', 11, 8), (10, 'A#', 6, 3), (11, 'B', 1, 10)) t(p, n, major, minor))"""
_SQL_KEYS = f"""(SELECT p_partkey, n || CASE WHEN m THEN 'm' ELSE '' END AS standard, CASE WHEN m THEN minor || 'A' ELSE major || 'B' END AS camelot, CASE WHEN m THEN minor || 'm' ELSE major || 'd' END AS open_key
    FROM (SELECT p_partkey, p_size % 12 AS q, p_partkey % 2 = 1 AS m FROM part) JOIN {_SQL_WHEEL} ON q = p)"""


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    p, m = F.col("p_size"), F.col("p_partkey") % 2 == 1
    return read(spark, sf, "part").select("p_partkey", keys.standard(p, m).alias("standard"), keys.camelot(p, m).alias("camelot"), keys.open_key(p, m).alias("open_key"))


@query(f"SELECT * FROM {_SQL_KEYS}")
def key_notations(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf)


@query(f"""WITH c AS (SELECT p_partkey, camelot, camelot[:-2]::INT AS n, camelot[-1] AS l FROM {_SQL_KEYS})
    SELECT p_partkey, 0 AS place, camelot AS code FROM c UNION ALL SELECT p_partkey, 1, CASE n WHEN 12 THEN 1 ELSE n + 1 END || l FROM c
    UNION ALL SELECT p_partkey, 2, CASE n WHEN 1 THEN 12 ELSE n - 1 END || l FROM c UNION ALL SELECT p_partkey, 3, n || CASE l WHEN 'A' THEN 'B' ELSE 'A' END FROM c""")
def compatible_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _keys(spark, sf).select("p_partkey", F.posexplode(keys.compatible(F.col("camelot"))).alias("place", "code"))


@query("SELECT event_id, (70 + floor(value * 1000)::BIGINT % 110)::DOUBLE AS bpm FROM events")
def placeholder_bpm(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", tracks.placeholder_bpm(F.col("value")).alias("bpm"))


@query("SELECT doc_id, (n_chars % 24 % 12)::INT AS pitch_class, n_chars % 24 >= 12 AS is_minor FROM documents")
def placeholder_key(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", tracks.placeholder_key(F.col("n_chars")).alias("k")).select("doc_id", "k.*")


@query("SELECT event_id, round(value / 2, 6) AS bpm, 0.4::DOUBLE AS confidence FROM events UNION ALL SELECT event_id, round(value * 2, 6), 0.4::DOUBLE FROM events")
def bpm_candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = read(spark, sf, "events").select("event_id", F.explode(tracks.candidates(F.col("value"), F.lit(0.8))).alias("c"))
    return e.select("event_id", F.round("c.value", 6).alias("bpm"), "c.confidence")


@query("SELECT event_id, value FROM events WHERE abs(value - 120) <= 5 OR abs(2 * value - 120) <= 5 OR abs(value / 2 - 120) <= 5")
def bpm_octave_match(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").where(tracks.bpm_matches(F.col("value"), 120.0, 5.0)).select("event_id", "value")


@query("""WITH v AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'NaN'::DOUBLE WHEN 1 THEN 'Infinity'::DOUBLE WHEN 2 THEN -value WHEN 3 THEN value * 10 ELSE value / 400 END AS x FROM events)
    SELECT event_id, CASE WHEN isfinite(x) AND x > 0 THEN least(greatest(x, 1.0::DOUBLE), 999.99::DOUBLE) ELSE 120.0::DOUBLE END AS bpm, CASE WHEN isfinite(x) AND x >= 0 THEN round(x)::BIGINT ELSE 0 END AS seconds,
      CASE WHEN isfinite(x) THEN round(least(greatest(x * 100, 0.0::DOUBLE), 100.0::DOUBLE), 6) ELSE 0.0::DOUBLE END AS percent FROM v""")
def export_guards(spark: SparkSession, sf: str) -> DataFrame:
    k, v = F.col("event_id") % 5, F.col("value")
    x = F.when(k == 0, float("nan")).when(k == 1, float("inf")).when(k == 2, -v).when(k == 3, v * 10).otherwise(v / 400)
    e = read(spark, sf, "events").select("event_id", x.alias("x"))
    return e.select("event_id", tracks.safe_bpm(F.col("x")).alias("bpm"), tracks.safe_seconds(F.col("x")).alias("seconds"), F.round(tracks.safe_percent(F.col("x")), 6).alias("percent"))


@query(_sql_cells(f"SELECT vec_id, list_transform(range(0, 11), lambda k: list_sum(e[6 * k + 1 : 6 * k + 6]) / len(e[6 * k + 1 : 6 * k + 6])) AS x FROM {_SQL_E}"))
def to_mono(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_samples(spark, sf).select("vec_id", arrays.to_mono(F.col("e"), 6).alias("x")), "vec_id")


@query(_sql_cells(f"SELECT vec_id, flatten(list_transform(range(0, 13), lambda k: [e[5 * k + 1], coalesce(e[5 * k + 2], e[5 * k + 1])])) AS x FROM {_SQL_E}"))
def downmix(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_samples(spark, sf).select("vec_id", arrays.downmix(F.col("e"), 5).alias("x")), "vec_id")


@query(_sql_cells(f"SELECT vec_id, list_transform(range(1, 65), lambda i: CASE WHEN i % 2 = 1 THEN e[(i + 1) // 2] ELSE e[32 + i // 2] END) AS x FROM {_SQL_E}"))
def interleave(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf)
    return _cells(e.select("vec_id", arrays.interleave(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("x")), "vec_id")


@query(_sql_cells(f"SELECT vec_id, list_transform(range(0, 31), lambda i: e[2 * i + 1] - e[2 * i + 2]) AS x FROM {_SQL_E}"))
def deinterleave_difference(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf).select("vec_id", F.slice("e", 1, 63).alias("e"))  # an odd sample at the end
    x = F.zip_with(arrays.deinterleave(F.col("e"), 0), arrays.deinterleave(F.col("e"), 1), lambda a, b: a - b)
    return _cells(e.select("vec_id", x.alias("x")), "vec_id")


def _sql_resample(a: int, b: int) -> str:
    r = f"({a}::DOUBLE / {b}::DOUBLE)"
    k = f"floor(i * {r})::BIGINT"
    return f"SELECT vec_id, {b} AS rate, list_transform(range(0, floor(len(e) / {r})::BIGINT), lambda i: coalesce(e[{k} + 1] + (e[{k} + 2] - e[{k} + 1]) * (i * {r} - {k}), e[{k} + 1], e[len(e)])) AS x FROM {_SQL_E}"


@query(_sql_cells(" UNION ALL ".join([_sql_resample(44100, 22050), _sql_resample(44100, 32000), _sql_resample(22050, 44100)]), "vec_id, rate"))
def resample_linear(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf)
    made = [e.select("vec_id", F.lit(b).alias("rate"), arrays.resample_linear(F.col("e"), a, b).alias("x")) for a, b in ((44100, 22050), (44100, 32000), (22050, 44100))]
    return _cells(made[0].union(made[1]).union(made[2]), "vec_id", "rate")


_SQL_CHUNKS = """(SELECT doc_id, n, i AS index, 900 * i AS start, least(900 * i + 1000, n) AS "end" FROM (SELECT doc_id, n_chars AS n, unnest(range(0, (n_chars + 899) // 900)) AS i FROM documents)
    WHERE CASE WHEN n <= 1000 THEN i = 0 ELSE i = 0 OR n - 900 * i >= 100 END)"""


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "documents").select("doc_id", F.explode(arrays.chunk_plan(F.col("n_chars"), 1000, 100)).alias("c"), F.size(arrays.chunk_plan(F.col("n_chars"), 1000, 100)).alias("n_chunks")).select("doc_id", "n_chunks", "c.*")


@query(f"""SELECT doc_id, index::INT AS index, start, "end" FROM {_SQL_CHUNKS}""")
def chunk_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).drop("n_chunks")


@query(f"""SELECT doc_id, index::INT AS index, round(list_sum(list_transform(range(0, l), lambda j: CASE WHEN index > 0 AND j < f THEN j / f ELSE 1 END * CASE WHEN NOT last AND j >= l - f THEN (l - j) / f ELSE 1 END)), 4) AS weight
    FROM (SELECT doc_id, index, "end" - start AS l, least(100, "end" - start)::DOUBLE AS f, index = max(index) OVER (PARTITION BY doc_id) AS last FROM {_SQL_CHUNKS})""")
def crossfade_weights(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf)
    w = arrays.crossfade(F.col("end") - F.col("start"), 100, F.col("index") == 0, F.col("index") == F.col("n_chunks") - 1)
    return c.select("doc_id", "index", F.round(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), 4).alias("weight"))


@query(_sql_cells("SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings"))
def overlap_add(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of 20 samples with 5 in common, weighted and added up again: the samples themselves."""
    e = _samples(spark, sf)
    c = e.select("vec_id", "e", F.explode(arrays.chunk_plan(F.size("e"), 20, 5)).alias("c"), F.size(arrays.chunk_plan(F.size("e"), 20, 5)).alias("n"))
    w = arrays.crossfade(F.col("c.end") - F.col("c.start"), 5, F.col("c.index") == 0, F.col("c.index") == F.col("n") - 1)
    part = F.slice("e", (F.col("c.start") + 1).cast("int"), (F.col("c.end") - F.col("c.start")).cast("int"))
    cells = c.select("vec_id", F.col("c.start").alias("start"), F.posexplode(F.arrays_zip(w.alias("w"), part.alias("x"))).alias("k", "p"))
    total = cells.groupBy("vec_id", (F.col("start") + F.col("k")).cast("int").alias("pos")).agg(F.sum(F.col("p.w") * F.col("p.x")).alias("wx"), F.sum("p.w").alias("w"))
    return total.select("vec_id", "pos", _round(F.col("wx") / F.when(F.col("w") > arrays.TINY, F.col("w")).otherwise(1.0)).alias("value"))


_SQL_WAVE = f"(SELECT vec_id, list_transform(range(0, 64), lambda j: e[j + 1] * 0.5::DOUBLE * (1 - cos(2 * pi() * j / 64))) AS y FROM {_SQL_E})"


@query(_sql_cells(f"""SELECT vec_id, list_transform(range(0, 33), lambda k: sqrt(list_sum(list_transform(y, lambda v, j: v * cos(2 * pi() * k * (j - 1) / 64))) ** 2 + list_sum(list_transform(y, lambda v, j: v * sin(2 * pi() * k * (j - 1) / 64))) ** 2)) AS x FROM {_SQL_WAVE}"""))
def spectrum_magnitude(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(detect.spectra(_samples(spark, sf), "vec_id", "e", 64), "vec_id")


@query(_sql_cells(f"SELECT vec_id, list_transform(e, lambda v: trunc(least(greatest(v * 3 * 32767, -32768.0::DOUBLE), 32767.0::DOUBLE))) AS x FROM {_SQL_E}"))
def pcm_quantise(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf).select("vec_id", F.transform("e", lambda v: v * 3).alias("e"))
    return _cells(e.select("vec_id", arrays.pcm16(F.col("e")).alias("x")), "vec_id")


_SQL_AUTO = f"""(SELECT vec_id, list_transform(range(4, 33), lambda k: list_dot_product(z[1 : 64 - k], z[k + 1 : 64])) AS x
    FROM (SELECT vec_id, list_transform(e, lambda v: v - list_sum(e) / 64) AS z FROM {_SQL_E}))"""


@query(_sql_cells(f"SELECT vec_id, x FROM {_SQL_AUTO}"))
def autocorrelation(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(_samples(spark, sf).select("vec_id", arrays.autocorrelation(F.col("e"), 4, 32).alias("x")), "vec_id")


@query(f"""WITH c AS (SELECT vec_id, list_transform(range(1, 13), lambda i: abs(embedding[i]::DOUBLE)) AS h FROM embeddings),
    g AS (SELECT vec_id, h, p, m, CASE WHEN m = 0 THEN [{", ".join(f"{v}::DOUBLE" for v in detect.MAJOR)}] ELSE [{", ".join(f"{v}::DOUBLE" for v in detect.MINOR)}] END AS w FROM c, range(12) a(p), range(2) b(m)),
    r AS (SELECT vec_id, p, m, w, h, list_sum(h) / 12 AS mh, list_sum(w) / 12 AS mw FROM g),
    s AS (SELECT vec_id, p, m, list_sum(list_transform(range(0, 12), lambda i: (h[i + 1] - mh) * (w[((i - p + 12) % 12) + 1] - mw))) / sqrt(list_sum(list_transform(h, lambda v: (v - mh) ** 2)) * list_sum(list_transform(w, lambda v: (v - mw) ** 2))) AS score FROM r)
    SELECT vec_id, p::INT AS pitch_class, m = 1 AS is_minor, round(score, 5) AS score FROM s""")
def chroma_key_scores(spark: SparkSession, sf: str) -> DataFrame:
    e = _samples(spark, sf).select("vec_id", F.transform(F.slice("e", 1, 12), F.abs).alias("h"))
    return e.select("vec_id", F.explode(detect.key_scores(F.col("h"))).alias("s")).select("vec_id", "s.pitch_class", "s.is_minor", F.round("s.score", 5).alias("score"))


@query(_sql_cells(f"""SELECT vec_id, flatten(list_transform(range(0, 33), lambda k: [list_sum(list_transform(y, lambda v, j: v * cos(2 * pi() * k * (j - 1) / 64))),
      -list_sum(list_transform(y, lambda v, j: v * sin(2 * pi() * k * (j - 1) / 64)))])) AS x FROM {_SQL_WAVE}"""))
def polar_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Magnitude and phase of each bin, put together again: its real and imaginary part."""
    e = _samples(spark, sf)
    m, p = (arrays.spectrum(F.col("e"), 64, part) for part in ("magnitude", "phase"))
    x = F.flatten(F.transform(arrays.from_polar(m, p), lambda z: F.array(z["re"], z["im"])))
    return _cells(e.select("vec_id", x.alias("x")), "vec_id")


@query("SELECT vec_id, label AS rate, CASE WHEN label > 0 THEN len(embedding)::DOUBLE / label ELSE 0.0 END AS seconds FROM embeddings")
def buffer_seconds(spark: SparkSession, sf: str) -> DataFrame:
    """Durations at odd rates, 0 among them."""
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").alias("rate"), arrays.duration(F.col("embedding"), F.col("label")).alias("seconds"))


_SQL_ODD_CODES = """(SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_size || 'A' WHEN 1 THEN p_size || 'X' WHEN 2 THEN 'B' WHEN 3 THEN (p_size + 230) || 'B' ELSE p_size || 'B' END AS code FROM part)"""


@query(f"""WITH c AS (SELECT p_partkey, code, CASE WHEN length(code) >= 2 AND n BETWEEN 0 AND 255 THEN n ELSE 0 END AS n, right(code, 1) AS l
      FROM (SELECT *, coalesce(TRY_CAST(regexp_extract(code, '^([0-9]+)', 1) AS INT), -1) AS n FROM {_SQL_ODD_CODES})),
    w AS (SELECT p_partkey, code, unnest([n, CASE WHEN n = 12 THEN 1 ELSE n + 1 END, CASE WHEN n = 1 THEN 12 ELSE n - 1 END, n]) AS k, unnest([l, l, l, CASE WHEN l = 'A' THEN 'B' ELSE 'A' END]) AS s, unnest([0, 1, 2, 3]) AS place FROM c WHERE n > 0)
    SELECT p_partkey, code, place, CASE WHEN k BETWEEN 1 AND 12 AND s IN ('A', 'B') THEN k || s ELSE '' END AS near FROM w""")
def compatible_odd_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of codes that are off the wheel, or no codes."""
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    code = F.when(k == 0, F.concat(size, F.lit("A"))).when(k == 1, F.concat(size, F.lit("X"))).when(k == 2, "B").when(k == 3, F.concat((F.col("p_size") + 230).cast("string"), F.lit("B"))).otherwise(F.concat(size, F.lit("B")))
    p = read(spark, sf, "part").select("p_partkey", code.alias("code"))
    return p.select("p_partkey", "code", F.posexplode(keys.compatible(F.col("code"))).alias("place", "near"))


_SQL_TRACKS = f"""SELECT url AS path, {_sql_fnv("lower(replace(url, chr(92), '/'))")} AS track_id, (70 + page_id * 1000 % 110)::DOUBLE AS bpm, n || CASE WHEN m THEN 'm' ELSE '' END AS standard, CASE WHEN m THEN minor || 'A' ELSE major || 'B' END AS camelot
    FROM (SELECT *, length(html) % 24 % 12 AS q, length(html) % 24 >= 12 AS m FROM pages) JOIN {_SQL_WHEEL} ON q = p"""


def _catalogue(spark: SparkSession, sf: str) -> DataFrame:
    p = read(spark, sf, "pages").select(F.col("url").alias("path"), F.col("page_id").cast("double").alias("seconds"), F.length("html").alias("samples"))
    k = tracks.placeholder_key(F.col("samples"))
    return p.select("path", paths.track_id(F.col("path")).alias("track_id"), tracks.placeholder_bpm(F.col("seconds")).alias("bpm"), keys.standard(k["pitch_class"], k["is_minor"]).alias("standard"), keys.camelot(k["pitch_class"], k["is_minor"]).alias("camelot"))


@query(_SQL_TRACKS)
def track_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: identity, tempo and key of every file, with the placeholder detectors."""
    return _catalogue(spark, sf)


@query(f"SELECT path, track_id, bpm, camelot, NULL::VARCHAR AS genre FROM ({_SQL_TRACKS})")
def track_json(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks as JSON documents, read back: what is null is not written, and null again when read."""
    t = _catalogue(spark, sf)
    doc = F.to_json(F.struct("path", "track_id", F.struct(F.lit(None).cast("string").alias("genre")).alias("metadata"), F.struct(F.col("bpm").alias("value")).alias("bpm"), F.struct("camelot").alias("key")))
    back = F.from_json(doc, "path string, track_id int, metadata struct<genre:string>, bpm struct<value:double>, key struct<camelot:string>")
    return t.select(back.alias("t")).select("t.path", "t.track_id", F.col("t.bpm.value").alias("bpm"), "t.key.camelot", "t.metadata.genre")
