"""Queries of the acquisition plane and of smaller functions: inputs written as columns over the shared tables, with SQL beside them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, regions, strings, times, urls, vectors
from ..operators import cameras, joins, passages
from ..session import SearchSettings
from ..sources import lists, media
from . import catalog, discovery
from . import search as searching
from .adapters import VISUALS, query_vector, table, visuals
from .catalog import query


def pick(key: str, *values: str | None) -> tuple[Callable[[], Column], str]:
    """The value that a key's remainder picks, as what makes a column (which needs a session) and as SQL; {k} in a value is the key."""
    n = len(values)
    text = f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''").replace("{k}", f"' || {key} || '") + "'") for i, v in enumerate(values)) + " END"

    def column() -> Column:
        out = F.lit(None).cast("string")
        for i, v in enumerate(values):
            parts = [F.lit(None).cast("string")] if v is None else [x for p in v.split("{k}") for x in (F.lit(p), F.col(key).cast("string"))][:-1]
            out = F.when(F.col(key) % n == i, F.concat(*parts)).otherwise(out)
        return out

    return column, text


_FLAG, _FLAG_SQL = pick("c_custkey", None, " ", "No", "OFF ", "yes", "0", "False", "disabled", "1")


@query(f"SELECT c_custkey, coalesce(lower(trim({_FLAG_SQL})), '') NOT IN ('0', 'false', 'no', 'off', 'disabled') AS enabled FROM customer")
def enabled_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", strings.is_enabled(_FLAG()).alias("enabled"))


_SITE, _SITE_SQL = pick(
    "c_custkey", "https://youtu.be/{k}", "https://www.youtube.com:443/{k}", "https://notyoutube.com/{k}", "https://youtube.com.example/{k}", "HTTPS://M.YouTube.com/a{k}", "https://cam{k}.example/youtube.com/",
)


@query(f"WITH h AS (SELECT c_custkey, lower(split_part(regexp_extract({_SITE_SQL}, '^[A-Za-z]+://([^/?#]*)', 1), ':', 1)) AS h FROM customer) SELECT c_custkey, h IN ('youtu.be', 'youtube.com') OR ends_with(h, '.youtube.com') AS youtube FROM h")
def youtube_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", urls.is_youtube(_SITE()).alias("youtube"))


_LIST, _LIST_SQL = pick(
    "c_custkey", "https://cam.example/{k}/index.m3u8", "https://cam.example/{k}/INDEX.M3U8?x=1", "https://t.example/log?u={k}.m3u8", "ftp://cam.example/{k}.m3u8", "https://x.gstatic.com/{k}.m3u8", "/{k}.m3u8",
    "https://cam.example:8080/{k}.m3u8#t", "https://cam.example/{k}.m3u", "http:///{k}.m3u8",
)
_BLOCKED = " OR ".join(f"h = '{s}' OR ends_with(h, '.{s}')" for s in urls.BLOCKED_HOSTS)


@query(f"""WITH u AS (SELECT c_custkey, {_LIST_SQL} AS url FROM customer),
p AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_replace(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1), ':[0-9]*$', '')) AS h, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) AS path FROM u)
SELECT c_custkey, s IN ('http', 'https') AND h <> '' AND ends_with(path, '.m3u8') AND NOT ({_BLOCKED}) AS admissible FROM p""")
def admissible_playlists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", urls.is_playlist(_LIST()).alias("admissible"))


_PAGE, _PAGE_SQL = pick(
    "c_custkey", '<video src="https://cdn.example/{k}/index.m3u8?x=1&amp;y=2"> again "https://cdn.example/{k}/index.m3u8?x=1&amp;y=2"', 'var u="https:\\/\\/cdn.example\\/b{k}\\/live.M3U8"; k=h{k}.m3u8', "src: //cdn.example/f{k}.m3u8, nothing",
    '<a href="/up/e{k}.m3u8">beacon?u=https%3A%2F%2Fx.example%2Fg.m3u8', "https://youtu.be/z{k}.m3u8 http://a.example/x{k}.m3u8", "no stream {k}",
)
_TOKEN_SQL = r"""[^ \t\r\n'"<>`()\[\]{},;=]*\.[mM]3[uU]8[^ \t\r\n'"<>`()\[\]{},;]*""".replace("'", "''")


@query(f"""WITH p AS (SELECT c_custkey, {_PAGE_SQL} AS html FROM customer), t AS (SELECT c_custkey, unnest(regexp_extract_all(html, '{_TOKEN_SQL}')) AS raw FROM p),
c AS (SELECT c_custkey, regexp_replace(replace(replace(raw, '\\/', '/'), '&amp;', '&'), '^.*(https?://)', '\\1') AS u FROM t),
j AS (SELECT c_custkey, CASE WHEN u LIKE 'http%://%' THEN u WHEN u LIKE '//%' THEN 'https:' || u WHEN u LIKE '/%' THEN 'https://site.example' || u ELSE 'https://site.example/view/' || u END AS url FROM c WHERE NOT regexp_matches(lower(u), '^https?%3a%2f%2f'))
SELECT DISTINCT c_custkey AS source_id, url FROM j WHERE url NOT LIKE 'https://youtu.be/%'""")
def static_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.lit("https://site.example/view/page.html").alias("url"), _PAGE().alias("html"))
    return discovery.page_urls(pages)


_NAMES = (
    "https://A.example:443/o{o}/playlist.m3u8?token={k}", "https://a.example/o{o}/chunklist_w1.m3u8", "https://a.example/o{o}_output_1.m3u8", "https://a.example/o{o}/tracks-v1/mono.m3u8", "https://a.example/o{o}/video1_stream.m3u8?session=9",
    "https://a.example/o{o}/front.m3u8?cam=2", "https://cdn07.a.example/123e4567-e89b-12d3-a456-426614174000.m3u8",
)
_CANDIDATES = "SELECT l_suppkey AS source_id, CASE l_linenumber " + " ".join(f"WHEN {i} THEN '" + v.replace("{o}", "' || (l_orderkey % 4) || '").replace("{k}", "' || (l_orderkey % 3) || '") + "'" for i, v in enumerate(_NAMES, 1)) + " END AS url FROM lineitem"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate playlists of their suppliers."""
    url = F.lit(None).cast("string")
    for i, v in enumerate(_NAMES, 1):
        spoken = F.replace(F.replace(F.lit(v), F.lit("{o}"), (F.col("l_orderkey") % 4).cast("string")), F.lit("{k}"), (F.col("l_orderkey") % 3).cast("string"))
        url = F.when(F.col("l_linenumber") == i, spoken).otherwise(url)
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), url.alias("url")).filter("url is not null")


_GROUPS = f"""WITH c AS (SELECT DISTINCT * FROM ({_CANDIDATES}) WHERE url IS NOT NULL),
f AS (SELECT source_id, url, CASE WHEN regexp_matches(url, '/playlist|/chunklist|/video1') THEN 'https://a.example/' || regexp_extract(url, '/(o[0-9])/', 1) || '/' WHEN regexp_matches(url, '/tracks-v1/') THEN 'https://a.example/' || regexp_extract(url, '/(o[0-9])/', 1) || '/'
  WHEN regexp_matches(url, '_output_') THEN 'https://a.example/' || regexp_extract(url, '/(o[0-9])_', 1) WHEN regexp_matches(url, '/front') THEN url ELSE 'https://a.example/123e4567-e89b-12d3-a456-426614174000' END AS family,
  CASE WHEN regexp_matches(url, '/playlist|/123e') THEN 0 WHEN regexp_matches(url, '/front') THEN 1 ELSE 2 END AS rank FROM c),
g AS (SELECT source_id, family, string_agg(url, ' ' ORDER BY rank, contains(url, '?'), length(url), url) AS urls FROM f GROUP BY 1, 2),
h AS (SELECT *, split_part(urls, ' ', 1) AS preferred FROM g)"""


@query(f"{_GROUPS} SELECT source_id, family, urls, preferred, row_number() OVER (PARTITION BY source_id ORDER BY preferred) AS position FROM h")
def playlist_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = cameras.families(candidates(spark, sf_dir))
    return own.select("source_id", "family", F.array_join("urls", " ").alias("urls"), "preferred", F.col("position").cast("long").alias("position"))


@query(f"""{_GROUPS}, n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY preferred) AS position FROM h),
m AS (SELECT source_id, position, unnest(string_split(urls, ' ')) AS url, generate_subscripts(string_split(urls, ' '), 1) AS place FROM n),
k AS (SELECT source_id, position, place, url, url LIKE '%chunklist%' OR url LIKE '%front%' AS seen, NOT (url LIKE '%playlist%' OR url LIKE '%front%') AS ok FROM m),
r AS (SELECT *, CASE WHEN (place = 1 OR seen) AND ok THEN 0 WHEN seen THEN 1 END AS rank FROM k),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, position ORDER BY rank, place) AS rn FROM r WHERE rank IS NOT NULL) WHERE rn = 1),
u AS (SELECT * FROM (SELECT *, CASE WHEN rank = 0 THEN 'https://best.example/' || md5(url) ELSE url END AS stream_url FROM b)),
o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id, stream_url ORDER BY position) AS dup FROM u) WHERE dup = 1)
SELECT source_id, format('camera-{{:03d}}', row_number() OVER (PARTITION BY source_id ORDER BY stream_url)) AS camera_id, stream_url, CASE WHEN rank = 0 THEN length(url) ELSE 0 END AS bandwidth FROM o""")
def resolved_cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families resolved: master playlists and fronts don't answer, chunk lists and fronts were seen by a browser."""
    own = candidates(spark, sf_dir).distinct()
    u = F.col("url")
    probes = own.select("url").distinct().select(
        "url", (~(F.contains(u, F.lit("playlist")) | F.contains(u, F.lit("front")))).alias("ok"), F.concat(F.lit("https://best.example/"), F.md5(u)).alias("stream_url"), F.length(u).cast("long").alias("bandwidth"), F.lit(640).cast("long").alias("width"), F.lit(360).cast("long").alias("height"),
    )
    seen = own.filter(F.contains(u, F.lit("chunklist")) | F.contains(u, F.lit("front")))
    return cameras.numbered(cameras.resolved(cameras.families(own), probes, seen)).select("source_id", "camera_id", "stream_url", "bandwidth")


_ID, _ID_SQL = pick("c_custkey", "{k}.0", " {k}-1 ", "{k}.5", "00{k}")
_URL, _URL_SQL = pick("c_custkey", "https://cam{k}.example/", "", None, " https://cam{k}.example/x ", "https://www.youtube.com/{k}")
_LINK, _LINK_SQL = pick("c_custkey", "https://old{k}.example/", "https://old{k}.example/", None)
_CITY, _CITY_SQL = pick("c_custkey", "Den Haag", " O'Brien's  City!", "", None)


@query(f"""WITH r AS (SELECT c_custkey AS k, {_ID_SQL} AS id, c_name AS place, {_CITY_SQL} AS city, c_mktsegment AS country, {_URL_SQL} AS url, {_LINK_SQL} AS link, {_FLAG_SQL} AS enabled FROM customer),
v AS (SELECT *, trim(coalesce(nullif(url, ''), nullif(link, ''))) AS u FROM r WHERE coalesce(lower(trim(enabled)), '') NOT IN ('0', 'false', 'no', 'off', 'disabled')),
w AS (SELECT CASE WHEN regexp_matches(id, '^[0-9]+\\.0$') THEN (k)::VARCHAR ELSE trim(id) END AS id, trim(place) AS place, trim(coalesce(nullif(city, ''), 'unknown')) AS city, trim(country) AS country, u AS url FROM v WHERE u IS NOT NULL AND NOT contains(u, 'youtube.com'))
SELECT *, {" || '/' || ".join(f"coalesce(nullif(trim(regexp_replace(lower({c}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')" for c in ("country", "city", "place"))} AS slug FROM w""")
def source_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a source list in both forms at once: canonical columns first, older ones where those are empty."""
    rows = table(spark, sf_dir, "customer").select(_ID().alias("id"), F.col("c_name").alias("place"), _CITY().alias("city"), F.col("c_mktsegment").alias("country"), _URL().alias("url"), _LINK().alias("Link"), _FLAG().alias("enabled"))
    return lists.canonical(rows).drop("description")


@query("WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n FROM conversations) SELECT conv_id, string_agg(n, ',' ORDER BY i) AS lengths FROM t GROUP BY 1")
def response_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as response items that come back in another order than they were asked for."""
    from pyspark.sql import Window

    own = table(spark, sf_dir, "conversations").withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    item = F.struct(F.length("text").alias("n"), F.col("i").alias("index"))
    own = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"), F.count(F.lit(1)).cast("int").alias("asked"))
    own = own.select("conv_id", joins.by_index(F.col("items"), F.col("asked")).alias("items"))
    return own.select("conv_id", F.array_join(F.transform("items", lambda r: r["n"].cast("string")), ",").alias("lengths"))


_HEADER, _HEADER_SQL = pick("o_orderkey", "7", "-3", None, "soon", "2.5", "{k}")


@query(f"SELECT o_orderkey, CASE WHEN try_cast({_HEADER_SQL} AS DOUBLE) IS NOT NULL THEN greatest(0.0, try_cast({_HEADER_SQL} AS DOUBLE)) ELSE least(30.0::DOUBLE, pow(2.0, 1 + o_custkey % 7)) END AS delay FROM orders")
def retry_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", times.retry_delay(_HEADER(), 1 + F.col("o_custkey") % 7).alias("delay"))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN url[8:] END AS below, CASE WHEN url LIKE 'https://%' THEN url[8:] ELSE url END AS shown FROM pages")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", identity.relative_to(u, "https:/").alias("below"), identity.display_path(u, "https:/").alias("shown"))


@query("SELECT page_id, replace(replace(html, '\\/', '/'), '&amp;', '&') AS text FROM pages")
def unescaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", urls.unescape(F.col("html")).alias("text"))


_SCALED = "greatest(224, round_even({s}::DOUBLE * 224 / least(w, h), 0))::INT"


@query(f"WITH f AS (SELECT p_partkey, 64 + p_size * 37 AS w, 48 + p_size * 29 AS h FROM part), r AS (SELECT p_partkey, {_SCALED.format(s='w')} AS width, {_SCALED.format(s='h')} AS height FROM f) SELECT *, ((width - 224) // 2)::INT AS \"left\", ((height - 224) // 2)::INT AS top FROM r")
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "part").select("p_partkey", regions.crop_geometry((64 + F.col("p_size") * 37).cast("int"), (48 + F.col("p_size") * 29).cast("int")).alias("g"))
    return own.select("p_partkey", "g.width", "g.height", "g.left", "g.top")


@query("SELECT event_id, format('{:.6f}', value) AS shown FROM events")
def score_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", strings.score_text(F.col("value")).alias("shown"))


@query("SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT) AS v FROM embeddings WHERE len(embedding) = 64")
def float_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", vectors.as_floats(F.col("embedding").cast("array<double>"), 64).alias("v"))


@query("""WITH f AS (SELECT user_id, (event_id % 7)::DOUBLE / 2 AS t, min(event_id) AS first FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY first) - 1 AS position, t FROM f""")
def keyframe_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as what a frame probe prints for each user's video, two of three a key frame; times repeat."""
    frame = F.struct((F.col("event_id") % 3 != 0).cast("int").alias("key_frame"), ((F.col("event_id") % 7) / 2).cast("string").alias("best_effort_timestamp_time"))
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", frame.alias("f")))).alias("rows"), F.max(F.col("event_id") % 3 != 0).alias("any")).filter("any")
    payload = F.to_json(F.struct(F.transform("rows", lambda r: r["f"]).alias("frames")))
    return own.select("user_id", F.posexplode(media.keyframe_times(payload)).alias("p", "t")).select("user_id", F.col("p").cast("long").alias("position"), "t")


_COARSE = 150
_SMALL = catalog.ORACLES["semantic_search"].replace(f"WITH {VISUALS}, b AS", f"WITH {VISUALS}, cand AS (SELECT * FROM m ORDER BY score DESC, point_id LIMIT {_COARSE}), b AS", 1)
_SMALL = _SMALL.replace("AS rn FROM m WHERE media_type = 'video') WHERE rn = 1)", "AS rn FROM cand WHERE media_type = 'video') WHERE rn = 1)", 1).replace("AS rn FROM m WHERE media_type = 'image') WHERE rn = 1)", "AS rn FROM cand WHERE media_type = 'image') WHERE rn = 1)", 1)


@query(_SMALL)
def semantic_search_coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over fewer candidates than there are vectors: only what the coarse stage finds opens photos and windows."""
    own = visuals(spark, sf_dir)
    found = searching.search(own, query_vector(spark, sf_dir), 10, SearchSettings(candidate_limit=_COARSE, candidate_max_limit=_COARSE))
    return found.select("source_path", "media_type", "start_seconds", "end_seconds", "representative_seconds", "region_kind", F.col("region.x").alias("x"), F.col("region.scale").alias("scale"), F.round("raw_score", 6).alias("raw_score"))


@query("""WITH g AS (SELECT vec_id // 10 AS g, vec_id, list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings)
SELECT g, vec_id, round(avg(s) OVER (PARTITION BY g ORDER BY vec_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS smooth FROM g""")
def smoothed_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("g"), "vec_id", vectors.dot(F.col("embedding"), F.col("embedding")).alias("s"))
    own = own.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("vec_id", "s"))).alias("r"))
    own = own.select("g", F.transform("r", lambda x: x["vec_id"]).alias("ids"), F.transform("r", lambda x: x["s"]).alias("s"))
    own = own.select("g", "ids", passages.array_moving_average(F.col("s"), 5).alias("smooth"))
    return own.select("g", F.explode(F.arrays_zip("ids", "smooth")).alias("z")).select("g", F.col("z.ids").alias("vec_id"), F.round("z.smooth", 9).alias("smooth"))
