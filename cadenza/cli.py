"""Command line: python -m cadenza.cli -i MUSIC -o OUT"""

from __future__ import annotations

import argparse
import logging
import os
import sys

from cadenza.errors import CadenzaError
from cadenza.plans.library import Settings, run
from cadenza.sources import documents

# The names of genres.
GENRES = ("house", "techno", "trance", "dnb", "dubstep", "hiphop", "pop", "rock")

IMPORT = """
The collection is in {path}. To take it over with its tempos and keys:
  1. import that file as a collection in the player's XML view;
  2. open the playlist that begins with "{playlist}";
  3. import the playlist itself. Tracks that are dragged from it keep the tags they had."""


def parse(argv: list[str] | None = None) -> tuple[Settings, argparse.Namespace]:
    p = argparse.ArgumentParser(prog="cadenza", description=__doc__)
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--stems", action="store_true")
    p.add_argument("--stems-output")
    p.add_argument("--separator", default="onnx", choices=("onnx", "none"))
    p.add_argument("--genre", choices=GENRES)
    p.add_argument("-j", "--threads", type=int, default=0)
    p.add_argument("-r", "--recursive", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--force", action="store_true")
    p.add_argument("--json", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--overwrite", action="store_true", help="write new tracks only, without the earlier run's")
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    a = p.parse_args(argv)
    if not os.path.exists(a.input):
        p.error(f"no such input: {a.input}")
    if not os.path.isdir(os.path.dirname(os.path.abspath(a.output))):
        p.error(f"the folder of the output does not exist: {a.output}")
    s = Settings(a.input, a.output, a.stems, a.stems_output, a.separator if a.stems else "none", a.genre, recursive=a.recursive, force=a.force, json=a.json, dry_run=a.dry_run, merge=not a.overwrite)
    return s, a


def main(argv: list[str] | None = None) -> int:
    settings, a = parse(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else [logging.WARNING, logging.INFO, logging.DEBUG][min(a.verbose, 2)])
    threads = a.threads or max(1, (os.cpu_count() or 2) - (2 if a.stems else 1))
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("cadenza").master(os.environ.get("SPARK_MASTER", f"local[{threads}]")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        r = run(spark, settings)
    except CadenzaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    finally:
        spark.stop()
    if not a.quiet:
        print(f"{r.total} files: {r.successful} analysed, {r.skipped} skipped, {r.failed} failed")
        if r.analysed:
            print(f"{r.analysed / max(r.seconds, 1e-9):.2f} tracks/s")
        if r.xml:
            print(IMPORT.format(path=r.xml, playlist=documents.PLAYLIST))
    return r.exit_code


if __name__ == "__main__":
    sys.exit(main())
