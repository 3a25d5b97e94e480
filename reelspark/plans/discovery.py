"""Discovery of streams: pages and observed requests become cameras, in three stages over all sources at once."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.playlists import best_variant, explode_variants
from ..functions.urls import is_playlist, join_url, marked_tokens
from ..operators.cameras import discovery_json, families, numbered, resolved
from ..sources.journal import write_json


def page_urls(pages: DataFrame, marker: str = ".m3u8") -> DataFrame:
    """source_id, url: playlists that the text of pages(source_id, url, html) names, each once."""
    tokens = pages.select("source_id", F.col("url").alias("base"), F.explode(F.array_distinct(marked_tokens(F.col("html"), marker))).alias("token"))
    found = tokens.select("source_id", join_url(F.col("base"), F.col("token")).alias("url"))
    return found.filter(is_playlist(F.col("url"), marker)).distinct()


def observed_urls(requests: DataFrame) -> DataFrame:
    """source_id, url: playlists among the requests that a browser made."""
    return requests.filter(is_playlist(F.col("url"))).select("source_id", "url").distinct()


def probes(playlists: DataFrame) -> DataFrame:
    """What asking gave, of playlists(url, final_url, text; text null where it failed): the best variant, or the playlist itself."""
    best = best_variant(explode_variants(playlists.filter("text is not null").select(F.col("final_url").alias("url"), "text")), "url")
    best = best.select(F.col("url").alias("final_url"), "variant_url", "bandwidth", "width", "height")
    out = playlists.join(best, "final_url", "left")
    return out.select("url", F.col("text").isNotNull().alias("ok"), F.coalesce("variant_url", "final_url").alias("stream_url"), F.coalesce("bandwidth", F.lit(0)).alias("bandwidth"), "width", "height")


def cameras(pages: DataFrame, requests: DataFrame, playlists: DataFrame) -> DataFrame:
    """source_id, camera_id, stream_url, bandwidth, width, height."""
    seen = observed_urls(requests)
    return numbered(resolved(families(page_urls(pages).unionByName(seen).distinct()), probes(playlists), seen))


def discover(sources: DataFrame, pages: DataFrame, requests: DataFrame, playlists: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """A JSON text for each source in its order."""
    return discovery_json(cameras(pages, requests, playlists), sources, errors)


def write_metadata(root: str, source: dict, own: list[dict], now: str) -> None:
    """source.json and each camera.json of a source; first_seen outlives, broken files are replaced."""
    import json

    base = os.path.join(root, *source["slug"].split("/"))
    write_json(os.path.join(base, "source.json"), source | {"source_url": source["url"], "discovered_at": now, "camera_count": len(own)})
    for c in own:
        path = os.path.join(base, "cameras", c["camera_id"], "camera.json")
        try:
            with open(path, encoding="utf-8") as f:
                first = json.load(f).get("first_seen") or now
        except (OSError, ValueError, AttributeError):
            first = now
        write_json(path, {"camera_id": c["camera_id"], "source_id": source["id"], "page_url": source["url"], "stream_url": c["stream_url"], "resolution": c.get("resolution"), "bandwidth": c.get("bandwidth", 0), "first_seen": first, "last_seen": now})
