"""Deterministic identities: canonical JSON, asset ids, version-5 UUIDs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The URL namespace of RFC 4122, a fixed value.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
ASSET_PREFIX = "media:asset:v1:"
VISUAL_PREFIX = "media:visual:v1:"


def canonical_json(**fields: Column) -> Column:
    """Compact JSON with sorted keys, nulls kept, characters as they are."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def asset_id(file_size: Column, mtime_ns: Column, relative_path: Column, prefix: str = ASSET_PREFIX) -> Column:
    """SHA-256 over path, size and time; the prefix is a parameter, so that ids made elsewhere can be met."""
    text = F.concat(F.lit(prefix), canonical_json(file_size=file_size, mtime_ns=mtime_ns, relative_path=relative_path))
    return F.sha2(F.encode(text, "UTF-8"), 256)


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """Version-5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(0x3F).bitwiseOR(0x80)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def point_id(prefix: str = VISUAL_PREFIX) -> Column:
    """The id of a visual; its scale is no part of it."""
    text = canonical_json(
        asset_id=F.col("asset_id"), dimension=F.col("dimension"), height=F.col("region.height"), model_id=F.col("model_id"), preprocessing_version=F.col("preprocessing_version"),
        region_kind=F.col("region_kind"), sample_kind=F.col("sample_kind"), timestamp_us=F.col("timestamp_us"), width=F.col("region.width"), x=F.col("region.x"), y=F.col("region.y"),
    )
    return uuid5(F.concat(F.lit(prefix), text))


def relative_to(path: Column, root: str) -> Column:
    """The path below a root; null if it lies elsewhere."""
    base = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1)))


def display_path(path: Column, root: str) -> Column:
    """The path below a root, or the whole path."""
    return F.coalesce(relative_to(path, root), path)
