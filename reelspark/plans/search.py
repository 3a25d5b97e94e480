"""The search: nearest visuals, best regions, neighbourhoods, exact rescoring, passages, one ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import clock, duration_microseconds
from ..functions.vectors import check_query
from ..operators.intervals import STREAM, neighborhoods, refined, within
from ..operators.passages import select_passages
from ..operators.ranking import best_by_photo, best_by_timestamp, first_of, match_order, ranked, result_order, scored, top_k
from ..session import SearchSettings

AREA = ["asset_id", "source_path", "area_start_us", "area_end_us"]


def opportunities(matches: DataFrame, context_seconds: float, keys: Sequence[str] = ()) -> DataFrame:
    """n: photos and video neighbourhoods that the matches can become; one row, or one for each of the keys that has matches."""
    video = matches.filter("media_type = 'video'")
    hits = first_of(video, [*keys, "asset_id", "timestamp_us"], match_order())
    areas = neighborhoods(hits, context_seconds, [*keys, *STREAM]).select(*keys, F.lit(1).alias("one"))
    photos = matches.filter("media_type = 'image'").select(*keys, "asset_id").distinct().select(*keys, F.lit(1).alias("one"))
    return areas.unionByName(photos).groupBy(*keys).agg(F.count("one").alias("n"))


def limits(settings: SearchSettings, wanted: int) -> list[int]:
    """How many candidates are asked for, one try after another: doubled up to the hard limit."""
    hard = settings.candidate_max_limit
    out = [min(max(settings.candidate_limit, wanted), hard)]
    while out[-1] < hard:
        out.append(min(hard, 2 * out[-1]))
    return out


def overfetched(visuals: DataFrame, query: Sequence[float], wanted: int, settings: SearchSettings) -> tuple[DataFrame, int]:
    """Candidates, and how many were asked for in the end.

    Scores are made once: the best of the hard limit, a few thousand rows without their vectors, are fetched in order. All tries are
    counted in one job, each over the start of them.
    """
    tries = limits(settings, wanted)
    pool = ranked(top_k(scored(visuals, query).drop("vector"), tries[-1])).toArrow()
    spark, found = visuals.sparkSession, pool.num_rows
    own = spark.createDataFrame(pool)
    if len(tries) > 1 and found > tries[0]:
        counted = own.select("*", F.explode(F.filter(F.array(*[F.lit(k) for k in tries]), lambda k: k >= F.col("candidate_rank"))).alias("try"))
        counts = {r["try"]: r["n"] for r in opportunities(counted, settings.context_seconds, ["try"]).collect()}
        asked = next(k for k in tries if counts.get(k, 0) >= wanted or found < k or k == tries[-1])
    else:
        asked = tries[0]
    return own.filter(F.col("candidate_rank") <= asked), asked


def photos(matches: DataFrame) -> DataFrame:
    """Photo results: the best region of each."""
    none = F.lit(None).cast("double")
    return best_by_photo(matches).select(
        "source_path", "media_type", none.alias("start_seconds"), none.alias("end_seconds"), none.alias("representative_seconds"), "region_kind", "region", F.col("score").alias("raw_score")
    )


def videos(matches: DataFrame, visuals: DataFrame, query: Sequence[float], settings: SearchSettings, few: bool | None = True) -> DataFrame:
    """Video results: of each neighbourhood of hits its window is read whole, scored exactly, and a passage chosen. A window without rows gives none."""
    hits = best_by_timestamp(matches.filter("media_type = 'video'"))
    areas = refined(neighborhoods(hits, settings.context_seconds), settings.max_window_seconds)
    rows = within(areas, visuals.filter("media_type = 'video'"), duration_microseconds(settings.max_window_seconds), few=few)
    rows = scored(rows, query).withColumn("area_start_us", F.col("area.start_us")).withColumn("area_end_us", F.col("area.end_us")).drop("area", "vector")
    seen = first_of(rows, [*AREA, "timestamp_us"], match_order())
    # The stream is part of the group and, for the order of equals, of each observation.
    seen = seen.select(F.struct(*AREA).alias("area"), "timestamp_us", "source_path", "score", "region_kind", "region", "timestamp_seconds")
    passages = select_passages(seen, ["area"], settings.moving_average_frames)
    return passages.select(
        F.col("area.source_path").alias("source_path"), F.lit("video").alias("media_type"), (F.col("start_us") / 1_000_000).alias("start_seconds"), (F.col("end_us") / 1_000_000).alias("end_seconds"),
        F.col("representative.timestamp_seconds").alias("representative_seconds"), F.col("representative.region_kind").alias("region_kind"), F.col("representative.region").alias("region"),
        F.col("representative.score").alias("raw_score"),
    )


def search(visuals: DataFrame, query: Sequence[float], limit: int | None = None, settings: SearchSettings | None = None, exhaustive: bool = False) -> DataFrame:
    """Ranked photos and passages for a query vector; if exhaustive, every visual is a candidate and nothing is fetched before the results."""
    settings = settings or SearchSettings()
    wanted = settings.result_limit if limit is None else limit
    if isinstance(wanted, bool) or not isinstance(wanted, int) or wanted <= 0:
        raise ValueError("limit must be a positive integer")
    own = check_query(query)
    candidates = scored(visuals, own).drop("vector") if exhaustive else overfetched(visuals, own, wanted, settings)[0]
    # Fetched candidates are bounded by the hard limit, and so are the windows that they open: they may be broadcast. Others are counted.
    found = photos(candidates).unionByName(videos(candidates, visuals, own, settings, few=None if exhaustive else True))
    return found.orderBy(*result_order()).limit(wanted)


def rendered(results: DataFrame) -> DataFrame:
    """A text for each of few results, by position."""
    from pyspark.sql import Window

    own = results.withColumn("position", F.row_number().over(Window.orderBy(*result_order())))
    region = F.format_string("   region: %s x=%d y=%d width=%d height=%d scale=%s", "region_kind", "region.x", "region.y", "region.width", "region.height", F.regexp_replace(F.col("region.scale").cast("string"), r"\.0$", ""))
    passage = F.concat(F.lit("   passage: "), clock(F.col("start_seconds")), F.lit(" -> "), clock(F.col("end_seconds")), F.lit("\n   representative: "), clock(F.col("representative_seconds")))
    lines = F.concat_ws("\n", F.format_string("%d. %s", "position", "source_path"), passage, region, F.format_string("   raw score: %.6f", "raw_score"))
    return own.select("position", lines.alias("text"))


def search_text(store, embedder, text: str, limit: int | None = None, settings: SearchSettings | None = None) -> DataFrame:  # noqa: ANN001
    """The same for words: the store is checked before the words are embedded."""
    text = text.strip()
    if not text:
        raise ValueError("search query must not be blank")
    store.open(embedder.identity)
    return search(store.visuals(), embedder.embed_texts([text])[0], limit, settings)
