"""Regions of a frame: the full frame, then overlapping tiles of each scale, row by row."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import REGION

SCALES = (0.5,)
OVERLAP = 0.25


def scaled_length(full: Column, scale: float) -> Column:
    return F.least(full, F.greatest(F.lit(1), F.floor(full * F.lit(scale) + 0.5).cast("int")))


def axis_positions(full: Column, tile: Column, overlap: float = OVERLAP) -> Column:
    """Starts of the tiles along an axis: every stride, and one flush with the end."""
    stride = F.greatest(F.lit(1), F.floor(tile * F.lit(1 - overlap) + 0.5).cast("int"))
    last = (full - tile).cast("int")
    return F.when(tile >= full, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last, F.lit(0)), stride), F.array(last))))


def regions(width: Column, height: Column, scales: Sequence[float] = SCALES, overlap: float = OVERLAP) -> Column:
    """All regions of a frame as an array of structs (kind, region), in order; a tile that is the whole frame is left out."""

    def cell(kind: str, x: Column, y: Column, w: Column, h: Column, scale: float) -> Column:
        ints = [c.cast("int").alias(n) for n, c in (("x", x), ("y", y), ("width", w), ("height", h))]
        return F.struct(F.lit(kind).alias("region_kind"), F.struct(*ints, F.lit(float(scale)).alias("scale")).alias("region"))

    if not all(0 < s <= 1 for s in scales) or not 0 <= overlap < 1:
        raise ValueError("scales must be above 0 and at most 1, the overlap at least 0 and below 1")
    parts = [F.array(cell("full", F.lit(0), F.lit(0), width, height, 1.0))]
    for scale in scales:
        w, h = scaled_length(width, scale), scaled_length(height, scale)
        xs, ys = axis_positions(width, w, overlap), axis_positions(height, h, overlap)
        parts.append(_tiles(cell, xs, ys, w, h, scale, (w == width) & (h == height)))
    good = (width > 0) & (height > 0)
    return F.when(good, F.concat(*parts)).otherwise(F.raise_error(F.lit("frame sides must be positive")).cast(f"array<struct<region_kind string, region {REGION.simpleString()}>>"))


def _tiles(cell: Callable[..., Column], xs: Column, ys: Column, w: Column, h: Column, scale: float, whole: Column) -> Column:
    tiles = F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: cell("tile", x, y, w, h, scale))))
    return F.filter(tiles, lambda t: ~whole)


def region_list(width: int, height: int, scales: Sequence[float] = SCALES, overlap: float = OVERLAP) -> list[tuple[str, dict]]:
    """The same as regions(), for one frame that a task holds: (kind, region), in order."""
    if width <= 0 or height <= 0:
        raise ValueError("frame sides must be positive")
    rounded = lambda v: max(1, int(np.floor(v + 0.5)))

    def starts(full: int, tile: int) -> list[int]:
        return [0] if tile >= full else list(dict.fromkeys([*range(0, full - tile + 1, rounded(tile * (1 - overlap))), full - tile]))

    found = [("full", {"x": 0, "y": 0, "width": width, "height": height, "scale": 1.0})]
    for scale in scales:
        w, h = min(width, rounded(width * scale)), min(height, rounded(height * scale))
        if (w, h) != (width, height):
            found += [("tile", {"x": x, "y": y, "width": w, "height": h, "scale": float(scale)}) for y in starts(height, h) for x in starts(width, w)]
    return found


def explode_regions(frames: DataFrame, scales: Sequence[float] = SCALES, overlap: float = OVERLAP) -> DataFrame:
    """A row for each region of each frame (width, height), with its number from 0."""
    return frames.select("*", F.posexplode(regions(F.col("width"), F.col("height"), scales, overlap)).alias("region_index", "cell")).select("*", "cell.*").drop("cell")


def crop_frames(cells: DataFrame) -> DataFrame:
    """rgb24 of each frame cut to its region, row by row; bytes are sliced by numpy in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pydict()
            out = []
            for data, w, h, r in zip(own["rgb24"], own["width"], own["height"], own["region"], strict=True):
                if data is None or len(data) != w * h * 3:
                    raise ValueError("a frame must have three bytes for each pixel")
                out.append(np.frombuffer(data, np.uint8).reshape(h, w, 3)[r["y"] : r["y"] + r["height"], r["x"] : r["x"] + r["width"]].tobytes())
            at = batch.schema.get_field_index("rgb24")
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, type=batch.schema.field(at).type))

    return cells.mapInArrow(run, cells.schema)


def crop_geometry(width: Column, height: Column, edge: int = 224) -> Column:
    """What a shortest-edge resize and centre crop do: resized sides and the corner of the crop."""
    short = F.least(width, height)
    w, h = F.greatest(F.lit(edge), F.bround(width * edge / short).cast("int")), F.greatest(F.lit(edge), F.bround(height * edge / short).cast("int"))
    return F.struct(w.alias("width"), h.alias("height"), F.floor((w - edge) / 2).cast("int").alias("left"), F.floor((h - edge) / 2).cast("int").alias("top"))
