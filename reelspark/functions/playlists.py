"""Master playlists: attributes, variants and the best of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .urls import base_parts, resolve

#: An attribute as RFC 8216, 4.2 has it: a name, and a quoted string or whatever runs to the next comma.
_NAME, _QUOTED, _PLAIN = "[A-Z0-9-]+", '"[^"]*"', "[^,]*"
_PAIR = f"({_NAME})=({_QUOTED}|{_PLAIN})"
#: Lines end at any of \r\n, \r and \n, so a line starts where no other character stands before it.
_START = r"(?<![^\r\n])[ \t\x0B\f]*"
#: A line that is neither blank nor a tag, and a variant's tag with its attributes.
_URI, _VARIANT = _START + r"([^#\s][^\r\n]*)", _START + r"#EXT-X-STREAM-INF:([^\r\n]*)"


def pairs(line: Column) -> tuple[Column, Column]:
    """The attributes of a tag line, or of what follows its colon, as two arrays: names and values, these without quotes."""
    found = lambda group: F.regexp_extract_all(line, F.lit(_PAIR), F.lit(group))
    return found(1), F.transform(found(2), lambda v: F.btrim(F.trim(v), F.lit('"')))


def attribute(names: Column, values: Column, name: Column | str) -> Column:
    """The value of a name in pairs(), the last if it is repeated; null if there is none."""
    back = F.array_position(F.reverse(names), name)
    return F.when(back > 0, F.element_at(values, (-back).cast("int")))


def attributes(line: Column) -> Column:
    """Attributes of a tag line as a map; quoted values may hold commas; of repeated names the last counts."""
    names, values = pairs(F.regexp_extract(line, "^[^:]*:(.*)$", 1))
    own = F.array_distinct(names)
    return F.map_from_arrays(own, F.transform(own, lambda n: attribute(names, values, n)))


def _whole(text: Column) -> Column:
    """An integer of the text, as a parser of integers reads it; null otherwise."""
    return F.when(F.trim(text).rlike(r"^[+-]?\d+$"), F.trim(text).try_cast("long"))


def pixels(width: Column, height: Column) -> Column:
    return F.coalesce(width * height, F.lit(0))


def explode_variants(playlists: DataFrame) -> DataFrame:
    """A row for each variant of playlists(url, text): position, absolute variant url, bandwidth, sides, pixels.

    The uri of a variant is the next line that is no tag. So a playlist is cut at such lines: the tags of each part belong to the
    uri that follows it, and tags behind the last uri to none.
    """
    uris = F.regexp_extract_all("text", F.lit(_URI), F.lit(1))
    parts = F.split("text", _URI)
    # The part behind the last uri has no partner and is left out by the null test.
    of = F.flatten(F.zip_with(parts, uris, lambda part, uri: F.transform(F.when(uri.isNull(), F.array().cast("array<string>")).otherwise(F.regexp_extract_all(part, F.lit(_VARIANT), F.lit(1))), lambda tag: F.struct(tag.alias("tag"), F.rtrim(uri, F.lit(" \t\x0b\x0c")).alias("uri")))))
    root, folder = base_parts(F.col("url"))
    rows = playlists.select("url", root.alias("root"), folder.alias("folder"), F.posexplode(of).alias("position", "v"))
    base = ["url", "position", "root", "folder"]
    names, values = pairs(F.col("v.tag"))
    rows = rows.select(*base, "v.uri", names.alias("names"), values.alias("values"))
    own = lambda name: attribute(F.col("names"), F.col("values"), name)
    filled = lambda name: F.nullif(own(name), F.lit(""))
    rows = rows.select(*base, "uri", F.coalesce(filled("AVERAGE-BANDWIDTH"), filled("BANDWIDTH")).alias("speed"), F.split(F.lower(own("RESOLUTION")), "x", 2).alias("sides"))
    w, h = (_whole(F.try_element_at("sides", F.lit(i))) for i in (1, 2))
    rows = rows.select(*base, "uri", F.coalesce(_whole(F.col("speed")), F.lit(0)).alias("bandwidth"), w.alias("w"), h.alias("h"))
    both = F.col("w").isNotNull() & F.col("h").isNotNull()
    return rows.select(
        "url", "position", resolve(*[F.col(c) for c in ("url", "root", "folder", "uri")]).alias("variant_url"), "bandwidth", F.when(both, F.col("w")).alias("width"), F.when(both, F.col("h")).alias("height"),
        pixels(F.col("w"), F.col("h")).alias("pixels"),
    )


def best_variant(rows: DataFrame, *keys: str) -> DataFrame:
    """Of each key the variant of most pixels, then of most bandwidth; of equals the first."""
    others = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*others), F.struct("pixels", "bandwidth", -F.col("position")))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")
