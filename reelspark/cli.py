"""Commands: scan a folder, index it, search a store, list sources, discover streams. Results go to standard output, all else to standard error."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.times import clock
from .session import EmbeddingSettings, Settings, build_session, closing_all


def positive(text: str) -> int:
    try:
        value = int(text)
    except ValueError:
        value = 0
    if value <= 0:
        raise argparse.ArgumentTypeError("must be a positive integer")
    return value


def scan_text(metadata: DataFrame, root: str) -> DataFrame:
    """A text for each probed file, by path."""
    from .functions.identity import display_path

    shown = display_path(F.col("path"), root)
    sides = F.format_string("       %dx%d", "width", "height")
    rate = F.regexp_replace(F.format_string("%.6f", "fps"), r"\.?0+$", "")
    video = F.concat_ws("\n", F.concat(F.lit("VIDEO  "), shown), sides, F.concat(F.lit("       "), F.col("codec")), F.concat(F.lit("       "), rate, F.lit(" fps")), F.concat(F.lit("       "), clock(F.col("duration_seconds"))))
    image = F.concat_ws("\n", F.concat(F.lit("IMAGE  "), shown), sides)
    return metadata.orderBy("path").select(F.when(F.col("media_type") == "video", video).otherwise(image).alias("text"))


def told(text: str) -> None:
    """How far a command is: to standard error, never among its results."""
    print(text, file=sys.stderr, flush=True)


def main(args: Sequence[str] | None = None, engines: dict[str, Callable[[EmbeddingSettings], object]] | None = None) -> int:
    """Runs a command; engines make the embedders that the settings name. 0, or 1 if something failed."""
    parser = argparse.ArgumentParser(prog="reelspark")
    commands = parser.add_subparsers(dest="command", required=True)
    own = commands.add_parser("scan", help="list media below a folder with what a probe says")
    own.add_argument("path", nargs="?", default=None)
    own = commands.add_parser("index", help="index media below a folder, as far as that isn't done")
    own.add_argument("path", nargs="?", default=None)
    own.add_argument("--store", default=None)
    own = commands.add_parser("discover", help="cameras of the sources of a file, from tables of pages, requests and playlists")
    own.add_argument("sources")
    own.add_argument("--pages", required=True, help="source_id, url, html")
    own.add_argument("--requests", default=None, help="source_id, url")
    own.add_argument("--playlists", default=None, help="url, final_url, text")
    own.add_argument("--candidates-only", action="store_true", help="only the playlists that are named, none read")
    own = commands.add_parser("search", help="rank photos and passages for words")
    own.add_argument("query")
    own.add_argument("--store", default=None)
    own.add_argument("--limit", type=positive, default=None)
    own = commands.add_parser("sources", help="list enabled stream sources of a file")
    own.add_argument("path")
    own.add_argument("--only", action="append", default=None, help="id of a source; may be repeated")
    said = parser.parse_args(args)
    settings = Settings.from_environment()
    try:
        spark = build_session()
        if said.command == "scan":
            from .sources import media

            root = said.path or settings.data_dir
            found = media.parse_probe(media.probe(media.scan(spark, root), settings.ffprobe))
            for r in found.filter("error is not null").select("error").take(1):
                raise ValueError(r["error"])
            for r in scan_text(found, root).toLocalIterator():
                print(r["text"])
        elif said.command == "search":
            from .plans.embedding import create_embedder
            from .plans.search import rendered, search_text
            from .sources.store import VisualStore

            if not said.query.strip():
                raise ValueError("search query must not be blank")
            store, embedder = VisualStore(spark, said.store or settings.data_dir), create_embedder(settings.embedding, engines)
            with closing_all(embedder):
                results = search_text(store, embedder, said.query, said.limit, settings.search)
                print("\n\n".join(r["text"] for r in rendered(results).orderBy("position").collect()))
        elif said.command == "index":
            from .plans import indexing
            from .plans.embedding import create_embedder, divided
            from .sources.store import VisualStore

            # A service's limits hold for all tasks together.
            tasks = settings.embedding.concurrency if settings.embedding.engine == "api" else None
            limits = divided(settings.embedding, tasks) if tasks else settings.embedding
            root = said.path or settings.data_dir
            told(f"index: {root}")
            outcome = indexing.run(spark, root, VisualStore(spark, said.store or settings.data_dir), lambda: create_embedder(limits, engines), settings=settings, say=told, tasks=tasks)
            print(outcome.text())
            return outcome.exit_code
        elif said.command == "discover":
            from .plans import discovery
            from .sources.lists import read_sources

            sources = read_sources(spark, said.sources)
            if "position" not in sources.columns:
                sources = sources.withColumn("position", F.monotonically_increasing_id())
            read = lambda path, form: spark.read.parquet(path) if path else spark.createDataFrame([], form)
            pages, requests = read(said.pages, "source_id string, url string, html string"), read(said.requests, "source_id string, url string")
            if said.candidates_only:
                found = discovery.page_urls(pages).unionByName(discovery.observed_urls(requests)).distinct().orderBy("source_id", "url").select(F.to_json(F.struct("source_id", "url")).alias("json"))
            else:
                found = discovery.discover(sources, pages, requests, read(said.playlists, "url string, final_url string, text string"))
            for r in found.toLocalIterator():
                print(r["json"])
        else:
            from .sources.lists import read_sources

            rows = read_sources(spark, said.path)
            rows = rows.filter(F.col("id").isin(said.only)) if said.only else rows
            for r in rows.select(F.to_json(F.struct("*")).alias("text")).toLocalIterator():
                print(r["text"])
    except Exception as e:
        print(f"{said.command.capitalize()} failed: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
