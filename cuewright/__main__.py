"""Command line: ``python -m cuewright ingest STORE FILE [--type KIND]`` and ``search STORE QUERY [--limit N]``."""

from __future__ import annotations

import argparse
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

from cuewright.api import Engine
from cuewright.functions.media import INGESTED, KINDS
from cuewright.operators.search import checked_limit, close_names
from cuewright.session import get_spark


def chosen_path(spark: SparkSession, given: str, ask: Callable[[str], str] = input) -> str:
    """The file itself if there is one, else the one chosen among the videos beside it whose names are most like it.

    If none is like it, the first ten are offered; without a choice, and without videos, the program ends.
    """
    path = Path(given.strip().strip("\"'"))
    if path.is_file():
        return str(path)
    names = sorted(p.name for p in path.parent.iterdir() if p.is_file() and p.suffix.lower().lstrip(".") in INGESTED) if path.parent.is_dir() else []
    if not names:
        raise SystemExit(f"no video files beside {path}")
    found = close_names(spark.createDataFrame([(1, path.name)], "query_id int, query string"), spark.createDataFrame([(n,) for n in names], "name string"), first=10)
    offered = [r.name for r in found.orderBy("rank").collect()]
    print("Did you mean one of these?", *(f"{i}: {name}" for i, name in enumerate(offered, 1)), sep="\n")
    choice = ask(f"A number from 1 to {len(offered)}, or nothing to cancel: ").strip()
    if not choice.isdigit() or not 1 <= int(choice) <= len(offered):
        raise SystemExit("no file chosen")
    return str(path.parent / offered[int(choice) - 1])


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="cuewright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    ingest = commands.add_parser("ingest", help="index a media file with the subtitles beside it")
    ingest.add_argument("store")
    ingest.add_argument("file")
    ingest.add_argument("--type", default="unknown", choices=KINDS)
    search = commands.add_parser("search", help="find frames and dialogue")
    search.add_argument("store")
    search.add_argument("query")
    search.add_argument("--limit", type=int, default=5)
    given = parser.parse_args(args)
    engine = Engine(get_spark(), given.store)
    if given.command == "ingest":
        given.file = chosen_path(engine.spark, given.file)
        print(engine.ingest_media(given.file, given.type)["message"])
        return
    for row in engine.search(given.query, checked_limit(given.limit)).collect():
        name = (row.file or "").replace("\\", "/").rpartition("/")[2] or "Unknown"
        print(f"{row.modality:8} {row.score} {row.time:>10} {name}: {row.content[:80]}...")


if __name__ == "__main__":
    main()
