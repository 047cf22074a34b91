"""The relational steps of a library run: discovery filters, incremental selection, merging, counting, text guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions import keys, paths

MAX_FILE_BYTES = 2 * 1024**3
MIN_SECONDS = 3.0
SECONDS_PER_TRACK = 3
# Error kinds after which a run goes on with the next file.
RECOVERABLE = ("decode", "unsupported_format", "analysis", "file_not_found")
BPM_RANGE = (1.0, 999.99)


def discover(listing: DataFrame, path_col: str = "path", size_col: str = "size_bytes") -> DataFrame:
    """(path, format, size_bytes) of supported files; a null path is none."""
    p = F.col(path_col)
    return listing.select(p.alias("path"), paths.audio_format(p).alias("format"), F.col(size_col).alias("size_bytes")).where("format is not null")


def pending(files: DataFrame, done: DataFrame, on: str = "path") -> DataFrame:
    """Files that the previous result doesn't hold.  The side that Spark broadcasts is up to its size statistics."""
    return files.join(done.select(on).distinct(), on, "left_anti")


def already_done(files: DataFrame, done: DataFrame, on: str = "path") -> DataFrame:
    return files.join(done.select(on).distinct(), on, "left_semi")


def merge_stems(tracks: DataFrame, stems: DataFrame, on: str, order: str) -> DataFrame:
    """Every track with its first stem result by `order`, or nulls."""
    others = [c for c in stems.columns if c != on]
    first = stems.groupBy(on).agg(F.min_by(F.struct(*others), order).alias("_s")).select(on, "_s.*")
    return tracks.join(first, on, "left")


def by_format(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(format, n) by upper-cased extension, the most frequent first."""
    ext = paths.extension(F.col(path_col))
    named = F.upper(F.when(ext == "", "unknown").otherwise(F.coalesce(ext, F.lit("unknown"))))
    return files.groupBy(named.alias("format")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "format")


def by_directory(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(dir, n, first_name, last_name) in order of directory; names themselves are not gathered, as one may hold them all."""
    p = F.col(path_col)
    return files.groupBy(paths.parent(p).alias("dir")).agg(F.count("*").alias("n"), F.min(paths.file_name(p)).alias("first_name"), F.max(paths.file_name(p)).alias("last_name")).orderBy("dir")


def outcome_counts(outcomes: DataFrame, kind_col: str = "error_kind", existing: int = 0) -> DataFrame:
    """One row (total, successful, failed, skipped); a null kind is a success, a recoverable one a skip."""
    k = F.col(kind_col)
    skipped = F.count_if(k.isin(*RECOVERABLE))
    return outcomes.agg(
        (F.count("*") + existing).alias("total"), F.count_if(k.isNull()).alias("successful"),
        F.count_if(k.isNotNull() & ~k.isin(*RECOVERABLE)).alias("failed"), (skipped + existing).alias("skipped"),
    )


def eta_text(n: Column) -> Column:
    seconds = n * SECONDS_PER_TRACK
    return F.format_string("%dm %ds", F.floor(seconds / 60), seconds % 60)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def safe_bpm(x: Column) -> Column:
    """Clamped to what readers accept; 120 if it isn't finite and positive."""
    return F.when(finite(x) & (x > 0), F.least(F.greatest(x, F.lit(BPM_RANGE[0])), F.lit(BPM_RANGE[1]))).otherwise(F.lit(120.0))


def safe_seconds(x: Column) -> Column:
    """Whole seconds, halves up; 0 if it isn't finite or is negative."""
    return F.when(finite(x) & (x >= 0), F.round(F.least(x, F.lit(2147483647.0)))).otherwise(F.lit(0.0)).cast("bigint")


def safe_percent(x: Column) -> Column:
    return F.when(finite(x), F.least(F.greatest(x * 100, F.lit(0.0)), F.lit(100.0))).otherwise(F.lit(0.0))


def placeholder_bpm(seconds: Column) -> Column:
    return (F.lit(70) + F.floor(seconds * 1000) % 110).cast("double")


def placeholder_key(samples: Column) -> Column:
    """struct<pitch_class, is_minor> from the number of samples."""
    h = (samples % 24).cast("int")
    return F.struct(keys.pitch_class(h).alias("pitch_class"), (h >= 12).alias("is_minor"))


def candidates(bpm: Column, confidence: Column) -> Column:
    """Half and double tempo, at half the confidence."""
    return F.array(*(F.struct(v.alias("value"), (confidence * 0.5).alias("confidence")) for v in (bpm / 2, bpm * 2)))


def bpm_matches(found: Column, target: float, tolerance: float) -> Column:
    """Within the tolerance of the target directly, doubled or halved."""
    return (F.abs(found - target) <= tolerance) | (F.abs(found * 2 - target) <= tolerance) | (F.abs(found / 2 - target) <= tolerance)
