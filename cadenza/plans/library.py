"""A run over a music library: discover, leave out what is done, decode and analyse, separate stems, write documents."""

from __future__ import annotations

import logging
import os
import re
import sys
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.errors import AnalysisError, CadenzaError, DecodeError
from cadenza.functions import arrays, paths
from cadenza.operators import detect, stems, tracks
from cadenza.session import ship, stored
from cadenza.sources import audio, documents, listing

log = logging.getLogger(__name__)


@dataclass
class Settings:
    input: str
    output: str
    stems: bool = False
    stems_output: str | None = None
    separator: str = "none"
    genre: str | None = None
    detector: str = "spectral"
    partitions: int | None = None
    recursive: bool = True
    force: bool = False
    json: bool = True
    dry_run: bool = False
    #: Keep the earlier run's tracks in the new documents; False writes the new ones only.
    merge: bool = True
    #: Files of the output folder are no input.
    exclude_output: bool = True

    @property
    def stems_dir(self) -> str:
        return self.stems_output or f"{self.output}/stems"


@dataclass
class Result:
    total: int
    successful: int
    failed: int
    skipped: int
    #: Files that were analysed, how long that took, and the collection that was written.
    analysed: int = 0
    seconds: float = 0.0
    xml: str | None = None

    @property
    def exit_code(self) -> int:
        return 1 if self.failed else 0


ANALYSIS = (
    "ordinal long, path string, error_kind string, error string, metadata struct<title:string,artist:string,album:string,genre:string,year:int>, "
    "bpm struct<value:double,confidence:double,candidates:array<struct<value:double,confidence:double>>>, "
    "key struct<pitch_class:int,is_minor:boolean,standard:string,camelot:string,open_key:string,confidence:double>, "
    "duration_seconds double, sample_rate int, source_sample_rate int"
)


def analyse_one(data: bytes, detector: str, genre: str | None) -> dict:
    """Decode, detect and read tags of one file; raises a CadenzaError."""
    try:
        buffer = audio.decode(data)
        x = audio.resample(audio.mono(buffer), buffer.rate, audio.ANALYSIS_RATE)
    except CadenzaError:
        raise
    except Exception as e:  # a damaged file must not end the batch
        raise DecodeError(f"{type(e).__name__}: {e}") from e
    seconds = len(x) / audio.ANALYSIS_RATE
    if seconds < tracks.MIN_SECONDS:
        raise AnalysisError(f"too short: {seconds:.2f} s")
    tempo_of, key_of = detect.DETECTORS[detector]
    t, k = tempo_of(x, audio.ANALYSIS_RATE, genre), key_of(x, audio.ANALYSIS_RATE)
    return {
        "metadata": audio.read_tags(data),
        "bpm": {"value": t.value, "confidence": t.confidence, "candidates": [{"value": v, "confidence": c} for v, c in t.candidates]},
        "key": {"pitch_class": k.pitch_class, "is_minor": k.is_minor, "standard": k.standard, "camelot": k.camelot, "open_key": k.open_key, "confidence": k.confidence},
        "duration_seconds": seconds, "sample_rate": audio.ANALYSIS_RATE, "source_sample_rate": buffer.rate,
    }


def _content(path: str, content: bytes | None) -> bytes:
    if content is not None:
        return bytes(content)
    if (m := re.match(r"(\w+://[^/]*)(/.*)", path)) and m[1] != "file://":
        store, base = fs.FileSystem.from_uri(m[1] + "/")
        with store.open_input_file(base.rstrip("/") + m[2]) as f:
            return f.read()
    with open(re.sub("^file:/+", "/", path), "rb") as f:
        return f.read()


def analyse(files: DataFrame, detector: str = "spectral", genre: str | None = None) -> DataFrame:
    """(ordinal, path, size_bytes[, content][, at]) to ANALYSIS: a file that fails is a row with its error, and the rest go on.

    Without a `content` column workers read the files themselves, at `at` if there is such a column, else at the path.  One
    file is held at a time.
    """
    ship(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                out = {"ordinal": r["ordinal"], "path": r["path"], "error_kind": None, "error": None}
                try:
                    if r["size_bytes"] > tracks.MAX_FILE_BYTES:
                        raise DecodeError("larger than 2 GiB")
                    out |= analyse_one(_content(r.get("at") or r["path"], r.get("content")), detector, genre)
                except CadenzaError as e:
                    out |= {"error_kind": e.kind, "error": str(e)}
                except OSError as e:
                    out |= {"error_kind": "file_not_found", "error": str(e)}
                row = {c.split()[0]: None for c in ANALYSIS.split(", ")} | out
                yield pd.DataFrame([row])

    return files.mapInPandas(run, ANALYSIS)


def separate(analysed: DataFrame, settings: Settings) -> DataFrame:
    """(path, stems) of analysed tracks; a file that fails has null stems.  The model is opened once a task."""
    folder, name = os.path.abspath(settings.stems_dir), settings.separator
    repeated = analysed.groupBy(paths.file_stem(F.col("path")).alias("stem")).agg(F.count("*").alias("n"))
    rows = analysed.select("path", absolute(F.col("path"), settings.input).alias("at"), "track_id", paths.file_stem(F.col("path")).alias("stem")).join(repeated, "stem")
    base = F.when(F.col("n") > 1, F.concat_ws("_", "track_id", "stem")).otherwise(F.col("stem"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = stems.separator(name)
        for pdf in batches:
            for path, at, b in zip(pdf["path"], pdf["at"], pdf["base"], strict=True):
                try:
                    buffer = audio.decode(_content(at, None))
                    mix = np.stack([audio.resample(c, buffer.rate, audio.STEM_RATE) for c in audio.stereo(buffer)])
                    made = stems.write_stems(stems.separate(mix, model), folder, b, audio.STEM_RATE)
                except (CadenzaError, OSError) as e:
                    print(f"no stems for {path}: {e}", file=sys.stderr)
                    made = None
                yield pd.DataFrame({"path": [path], "stems": [made]})

    return rows.select("path", "at", base.alias("base")).mapInPandas(run, "path string, stems struct<vocals:string,drums:string,bass:string,other:string>")


def report(files: DataFrame, settings: Settings) -> Result:
    """The dry run: what would be done."""
    n, last = files.count(), None
    p = F.col("path")
    named = files.select("ordinal", "path", paths.parent(p).alias("dir"), paths.file_name(p).alias("name")).join(tracks.by_directory(files).select("dir", "n"), "dir")
    for r in named.orderBy("dir", F.col("ordinal").asc_nulls_last(), "path").toLocalIterator():
        if r.dir != last:
            print(f"{r.dir}/ ({r.n} files)")
            last = r.dir
        print(f"  {r.name}")
    for r in tracks.by_format(files).toLocalIterator():
        print(f"{r['format']}: {r.n}")
    print(f"about {n * tracks.SECONDS_PER_TRACK // 60}m {n * tracks.SECONDS_PER_TRACK % 60}s; would write {settings.output}/{documents.XML_NAME}" + f" and {documents.JSON_NAME}" * settings.json)
    return Result(n, 0, 0, n)


def absolute(path: Column, root: str) -> Column:
    """Paths below `root` with its real place in front; other relative ones are taken from the working folder."""
    if "://" in root:
        return path
    root = root.rstrip("/") or "/"
    inside = (path == root) | path.startswith(root.rstrip("/") + "/")
    here = F.when(path.startswith("/") | paths.has_drive(path), path).otherwise(F.concat(F.lit(f"{os.getcwd()}/"), path))
    return F.when(inside, F.concat(F.lit(os.path.realpath(root).rstrip("/")), F.substring(path, F.lit(len(root.rstrip("/")) + 1), F.length(path)))).otherwise(here)


def run(spark: SparkSession, settings: Settings) -> Result:
    output = settings.output if settings.exclude_output else None
    if "://" in settings.input:
        found = listing.store_listing(spark, settings.input, settings.recursive, output)
    else:
        found = listing.local_listing(spark, settings.input, settings.recursive, output)
    files = stored(found.select("*", paths.audio_format(F.col("path")).alias("format")).where("format is not null"), "files")
    total = files.count()
    if not total:
        return Result(0, 0, 0, 0)
    if settings.dry_run:
        return report(files, settings)
    earlier_path = f"{settings.output}/{documents.JSON_NAME}"
    earlier = None if settings.force else stored(documents.read_tracks(spark, earlier_path), "earlier")
    todo = files if earlier is None else tracks.pending(files, earlier)
    n = todo.count()
    if not n:
        return Result(total, 0, 0, total)
    began = time.perf_counter()
    parts = settings.partitions or max(spark.sparkContext.defaultParallelism, min(n, -(-n // 4)))
    rows = stored(analyse(todo.withColumn("at", absolute(F.col("path"), settings.input)).repartition(parts, "path"), settings.detector, settings.genre), "analysed")
    counts = tracks.outcome_counts(rows, existing=total - n).first()
    result = Result(counts.total, counts.successful, counts.failed, counts.skipped, n, time.perf_counter() - began)
    log.info("%d files in %.1f s: %.2f tracks/s", n, result.seconds, n / max(result.seconds, 1e-9))
    for r in rows.where("error_kind is not null").select("path", "error").toLocalIterator():
        print(f"skipped {r.path}: {r.error}", file=sys.stderr)
    if not counts.successful:
        return result
    good = rows.where("error_kind is null").withColumn("track_id", paths.track_id(F.col("path")))
    named = F.col("metadata").withField("title", paths.title(F.col("metadata.title"), F.col("path")))
    good = good.withColumn("metadata", named).withColumn("uri", paths.location_uri(absolute(F.col("path"), settings.input)))
    none = F.lit(None).cast("struct<vocals:string,drums:string,bass:string,other:string>")
    if settings.stems and settings.separator != "none":
        made = stored(separate(good, settings), "stems")
        good = good.join(made, "path", "left")
    else:
        good = good.withColumn("stems", none)
    made = documents.track_document(good, "ordinal", "uri", "sample_rate")
    if settings.merge and earlier is not None:
        old = earlier.join(files.select("path", "ordinal"), "path", "left").withColumn("uri", paths.location_uri(absolute(F.col("path"), settings.input)))
        made = made.unionByName(old.withColumn("sample_rate", F.lit(audio.ANALYSIS_RATE)))
    made = stored(made.orderBy(F.col("ordinal").asc_nulls_last(), "path"), "tracks")
    made, size, now = made.orderBy(F.col("ordinal").asc_nulls_last(), "path"), made.count(), datetime.now(UTC)
    os.makedirs(settings.output, exist_ok=True)
    result.xml = f"{settings.output}/{documents.XML_NAME}"
    documents.write_xml(made, result.xml, now, size)
    if settings.json:
        documents.write_json(made.drop("ordinal", "uri", "sample_rate"), earlier_path, now, size)
    return result


def duplicate_ids(analysed: DataFrame) -> DataFrame:
    """Track ids that stand for several paths."""
    return analysed.groupBy("track_id").agg(F.countDistinct("path").alias("n")).where("n > 1")


def buffers_analysed(samples: DataFrame, id_col: str, samples_col: str, rate: int) -> DataFrame:
    """Duration and 16-bit levels of buffers that are already decoded."""
    x = F.col(samples_col)
    return samples.select(id_col, arrays.duration(x, F.lit(rate)).alias("seconds"), F.array_max(arrays.pcm16(x)).alias("peak"))
