"""The two documents of a run: a collection in XML, for players' libraries, and a versioned JSON file.

Both are one file each, so the driver writes them, row by row as they arrive, under another name that is then replaced.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterable
from datetime import datetime
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cadenza import __version__
from cadenza.errors import OutputError

PLAYLIST = "Cadenza Import "
JSON_VERSION = "1.0"
JSON_NAME, XML_NAME = "cadenza.json", "collection.xml"
PRODUCT = "cadenza"

TRACK_SCHEMA = (
    "track_id int, path string, metadata struct<title:string,artist:string,album:string,genre:string>, "
    "bpm struct<value:double,confidence:double,candidates:array<struct<value:double,confidence:double>>>, "
    "key struct<standard:string,camelot:string,open_key:string,confidence:double>, duration_seconds double, "
    "stems struct<vocals:string,drums:string,bass:string,other:string>"
)
_DOCUMENT = f"version string, metadata struct<generator_version:string,exported_at:string,track_count:bigint>, tracks array<struct<{TRACK_SCHEMA.replace(' int', ':int').replace(' string', ':string').replace(' struct', ':struct').replace(' double', ':double')}>>"


def _replace(path: str, write: Callable) -> None:
    part = f"{path}.tmp"
    try:
        with open(part, "w", encoding="utf-8") as f:
            write(f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(part, path)
    except OSError as e:
        if os.path.exists(part):
            os.remove(part)
        raise OutputError(f"{path}: {e}") from e


def _plain(x):
    """A row as nested dicts without what is null; a number that isn't finite, which JSON can't express, becomes null."""
    if isinstance(x, float) and not _finite(x):
        return None
    if isinstance(x, Row):
        return {k: _plain(v) for k, v in x.asDict().items() if v is not None}
    return [_plain(v) for v in x] if isinstance(x, list) else x


def track_document(tracks: DataFrame, *extra: str) -> DataFrame:
    """The columns of a track in the JSON file, and any others asked for."""
    meta = F.struct(*(F.col(f"metadata.{x}").alias(x) for x in ("title", "artist", "album", "genre")))
    key = F.struct(*(F.col(f"key.{x}").alias(x) for x in ("standard", "camelot", "open_key", "confidence")))
    return tracks.select("track_id", "path", meta.alias("metadata"), "bpm", key.alias("key"), "duration_seconds", "stems", *extra)


def write_json(tracks: DataFrame, path: str, now: datetime, count: int) -> None:
    """`tracks` in the shape of `track_document`, in its order."""

    def write(f):
        head = {"generator_version": __version__, "exported_at": now.isoformat(), "track_count": count}
        f.write('{\n  "version": %s,\n  "metadata": %s,\n  "tracks": [' % (json.dumps(JSON_VERSION), json.dumps(head)))
        for i, r in enumerate(tracks.toLocalIterator()):
            doc = _plain(r)
            doc.setdefault("metadata", {})
            f.write((",\n    " if i else "\n    ") + json.dumps(doc, ensure_ascii=False))
        f.write("\n  ]\n}\n")

    _replace(path, write)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """The tracks of an earlier JSON file; none if it isn't there, can't be parsed, or lacks what every track must have."""
    empty = spark.createDataFrame([], TRACK_SCHEMA)
    if "://" not in path and not os.path.exists(path):
        return empty
    doc = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
    t = doc.select(F.explode("tracks").alias("t")).select("t.*")
    needed = ["track_id", "path", "metadata", "bpm.value", "bpm.confidence", "bpm.candidates", "key.standard", "key.camelot", "key.open_key", "key.confidence", "duration_seconds"]
    lacking = t.where(" or ".join(f"{c} is null" for c in needed)).limit(1)
    return empty if lacking.count() else t


def read_paths(spark: SparkSession, path: str) -> DataFrame:
    return read_tracks(spark, path).select("path").distinct()


def _finite(x: float | None) -> bool:
    return x is not None and x == x and abs(x) != float("inf")


def bpm_text(x: float | None) -> str:
    return f"{min(max(x, 1.0), 999.99):.2f}" if _finite(x) and x > 0 else "120.00"


def percent_text(x: float | None) -> str:
    return f"{min(max(x * 100, 0.0), 100.0):.0f}" if _finite(x) else "0"


def seconds_text(x: float | None) -> str:
    return str(int(x + 0.5)) if _finite(x) and x >= 0 else "0"


#: Characters that XML 1.0 can't hold, not even escaped.
_NO_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff\ud800-\udfff]")


def _attributes(pairs: Iterable[tuple[str, object]]) -> str:
    return "".join(f" {k}={quoteattr(_NO_XML.sub('', str(v)), {chr(10): '&#10;', chr(13): '&#13;', chr(9): '&#9;'})}" for k, v in pairs if v is not None)


def track_element(r: Row, now: datetime) -> str:
    m = r.metadata
    return "<TRACK" + _attributes([
        ("TrackID", r.track_id), ("Name", m.title if m.title is not None else "Unknown"), ("Artist", m.artist), ("Album", m.album), ("Genre", m.genre),
        ("Location", r.uri), ("TotalTime", seconds_text(r.duration_seconds)), ("AverageBpm", bpm_text(r.bpm.value)), ("Tonality", r.key.camelot),
        ("DateAdded", now.strftime("%Y-%m-%d")), ("SampleRate", r.sample_rate),
        ("Comments", f"{PRODUCT}: BPM conf={percent_text(r.bpm.confidence)}%, Key conf={percent_text(r.key.confidence)}%"),
    ]) + "/>"


def write_xml(tracks: DataFrame, path: str, now: datetime, count: int, playlist: str = PLAYLIST) -> None:
    """`tracks` in its order, with uri; then a playlist of all of them."""

    def write(f):
        f.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<DJ_PLAYLISTS Version="1.0.0">\n  <PRODUCT{_attributes([("Name", PRODUCT), ("Version", __version__), ("Company", PRODUCT)])}/>\n  <COLLECTION Entries="{count}">\n')
        for r in tracks.toLocalIterator():
            f.write(f"    {track_element(r, now)}\n")
        name = playlist + now.strftime("%Y%m%d_%H%M%S")
        f.write(f'  </COLLECTION>\n  <PLAYLISTS>\n    <NODE Type="0" Name="ROOT" Count="1">\n      <NODE{_attributes([("Name", name), ("Type", 1), ("KeyType", 0), ("Entries", count)])}>\n')
        for r in tracks.select("track_id").toLocalIterator():
            f.write(f'        <TRACK Key="{r.track_id}"/>\n')
        f.write("      </NODE>\n    </NODE>\n  </PLAYLISTS>\n</DJ_PLAYLISTS>\n")

    _replace(path, write)
