"""Media files: listing, classification, probes, keyframes, stills."""

from __future__ import annotations

import errno
import json
import os
import shutil
import subprocess
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAMES, PROBE

#: Suffixes and what they hold, fixed values.
VIDEO_SUFFIXES, IMAGE_SUFFIXES = (".mkv",), (".jpg", ".jpeg")


def media_type(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))
    return F.when(suffix.isin(*VIDEO_SUFFIXES), F.lit("video")).when(suffix.isin(*IMAGE_SUFFIXES), F.lit("image"))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """path, size, modified of every file below a root, hidden ones too; the tree is walked on the driver, where its times are exact."""
    if not os.path.exists(root):
        raise FileNotFoundError(errno.ENOENT, os.strerror(errno.ENOENT), root)
    if not os.path.isdir(root):
        raise NotADirectoryError(errno.ENOTDIR, os.strerror(errno.ENOTDIR), root)
    rows = []
    for folder, _, names in os.walk(root):
        for name in names:
            full = os.path.join(folder, name)
            if os.path.isfile(full):
                s = os.stat(full)
                rows.append((full, s.st_size, s.st_mtime_ns))
    return spark.createDataFrame(rows, "path string, file_size long, mtime_ns long")


def scan(spark: SparkSession, root: str) -> DataFrame:
    """Supported files below a root, by path."""
    return listing(spark, root).withColumn("media_type", media_type(F.col("path"))).filter("media_type is not null").orderBy("path")


def scan_store(spark: SparkSession, root: str) -> DataFrame:
    """The same for a store that only Spark reads: names beginning with _ or . are not listed there, times are in milliseconds."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", F.col("length").alias("file_size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"))
    return files.withColumn("media_type", media_type(F.col("path"))).filter("media_type is not null").orderBy("path")


def frame_rate(average: Column, base: Column) -> Column:
    """The first positive of two rates written as fractions or numbers."""

    def one(text: Column) -> Column:
        parts = F.split(text, "/")
        top, low = F.element_at(parts, 1).try_cast("double"), F.coalesce(F.try_element_at(parts, F.lit(2)).try_cast("double"), F.when(F.size(parts) == 1, F.lit(1.0)))
        return F.when((top > 0) & (low > 0), top / low)

    return F.coalesce(one(average), one(base))


def parse_probe(rows: DataFrame) -> DataFrame:
    """rows(path, media_type, payload) as path, media_type, width, height, codec, duration_seconds, fps and error (null if good)."""
    own = F.from_json("payload", PROBE)
    stream = F.try_element_at(own["streams"], F.lit(1))
    video = F.col("media_type") == "video"
    values = {
        "width": stream["width"],
        "height": stream["height"],
        "codec": F.when(video, stream["codec_name"]),
        "duration_seconds": F.when(video, own["format"]["duration"].try_cast("double")),
        "fps": F.when(video, frame_rate(stream["avg_frame_rate"], stream["r_frame_rate"])),
    }
    told = F.col("error") if "error" in rows.columns else F.lit(None).cast("string")
    out = rows.select("path", "media_type", told.alias("error"), *[v.alias(k) for k, v in values.items()])
    missing = [
        F.when(F.coalesce(F.col("width") > 0, F.lit(False)) & F.coalesce(F.col("height") > 0, F.lit(False)), None).otherwise(F.lit("sides")),
        F.when(video & F.coalesce(F.col("codec") == "", F.lit(True)), F.lit("codec")),
        F.when(video & ~F.coalesce(F.col("duration_seconds") >= 0, F.lit(False)), F.lit("duration")),
        F.when(video & F.col("fps").isNull(), F.lit("frame rate")),
    ]
    bad = F.array_compact(F.array(*missing))
    said = F.when(F.size(bad) > 0, F.concat(F.col("path"), F.lit(": no valid "), F.array_join(bad, ", ")))
    return out.withColumn("said", F.coalesce("error", said)).drop("error").withColumnRenamed("said", "error")


def probe(media: DataFrame, program: str = "ffprobe") -> DataFrame:
    """media(path, media_type) with the payload that the probe program prints, and error where it fails. Runs on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            payload, error = [], []
            for path in batch["path"]:
                try:
                    done = subprocess.run([program, "-v", "error", "-select_streams", "v:0", "-show_entries", "stream=codec_name,width,height,avg_frame_rate,r_frame_rate:format=duration", "-of", "json", path], capture_output=True, text=True, check=True)
                    payload.append(done.stdout)
                    error.append(None)
                except (OSError, subprocess.CalledProcessError) as e:
                    payload.append(None)
                    error.append(f"{path}: {getattr(e, 'stderr', None) or e}")
            yield batch[["path", "media_type"]].assign(payload=payload, error=error)

    return media.select("path", "media_type").mapInPandas(run, "path string, media_type string, payload string, error string")


def keyframe_times(payload: Column) -> Column:
    """Times of key frames in order, each once, the first kept; fails if there is none."""
    frames = F.from_json(payload, FRAMES)["frames"]
    times = F.transform(F.filter(frames, lambda f: F.coalesce(f["key_frame"] == 1, F.lit(False))), lambda f: f["best_effort_timestamp_time"].try_cast("double"))
    good = F.coalesce((F.size(times) > 0) & F.forall(times, lambda t: t.isNotNull() & (t >= 0)), F.lit(False))
    return F.when(good, F.array_distinct(times)).otherwise(F.raise_error(F.lit("no usable key frames")).cast("array<double>"))


def has_program(name: str) -> bool:
    return shutil.which(name) is not None


class KeyframeSampler:
    """A table function over one video: (timestamp_seconds, width, height, rgb24) of each key frame, read from the decoder's pipe.

    The i-th time belongs to the i-th frame; a short frame, a frame too many or a failing decoder is an error.
    """

    def eval(self, path: str, width: int, height: int, times: str, program: str):  # noqa: ANN201
        stamps = json.loads(times)
        # Frames come as they are stored: turned by the decoder, their sides would be swapped against the probe's.
        command = [program, "-v", "error", "-skip_frame", "nokey", "-noautorotate", "-i", path, "-map", "0:v:0", "-vsync", "passthrough", "-f", "rawvideo", "-pix_fmt", "rgb24", "-"]
        size = width * height * 3
        with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
            for t in stamps:
                data = run.stdout.read(size)
                if len(data) != size:
                    raise ValueError(f"{path}: the decoder gave fewer frames than there are key frames")
                yield t, width, height, data
            if run.stdout.read(1):
                raise ValueError(f"{path}: the decoder gave more frames than there are key frames")
            if run.wait():
                raise ValueError(f"{path}: the decoder failed: {run.stderr.read().decode(errors='replace')}")


def sampler():  # noqa: ANN201
    """The table function, to be called in a lateral join."""
    from pyspark.sql.functions import udtf

    return udtf(KeyframeSampler, returnType="timestamp_seconds double, width int, height int, rgb24 binary")


class StageError(Exception):
    """What kept an asset from being indexed, and at which stage."""

    def __init__(self, stage: str, message: str) -> None:
        super().__init__(stage, message)
        self.stage, self.message = stage, message


def probe_keyframes(path: str, program: str = "ffprobe") -> str:
    """What the probe program prints of a video's key frames: JSON that keyframe_times reads. Runs where it is called."""
    command = [program, "-v", "error", "-skip_frame", "nokey", "-select_streams", "v:0", "-show_frames", "-show_entries", "frame=key_frame,best_effort_timestamp_time", "-of", "json", path]
    try:
        return subprocess.run(command, capture_output=True, text=True, check=True).stdout
    except (OSError, subprocess.CalledProcessError) as e:
        raise StageError("sampling", f"{path}: {getattr(e, 'stderr', None) or e}") from e


def keyframe_list(payload: str) -> list[float]:
    """keyframe_times for one payload that a task holds."""
    try:
        times = [float(f["best_effort_timestamp_time"]) for f in json.loads(payload)["frames"] if f.get("key_frame") == 1]
    except (KeyError, TypeError, ValueError) as e:
        raise StageError("sampling", "key frames can't be read") from e
    if not times or not all(0 <= t < float("inf") for t in times):
        raise StageError("sampling", "no usable key frames")
    return list(dict.fromkeys(times))


def read_image(content: bytes, width: int, height: int) -> bytes:
    """RGB bytes of a still image, whose sides must be those of the probe. Needs Pillow."""
    import io

    try:
        from PIL import Image

        image = Image.open(io.BytesIO(content)).convert("RGB")
    except Exception as e:
        raise StageError("decode", f"the image can't be read: {e}") from e
    if image.size != (width, height):
        raise StageError("decode", f"sides are {image.size[0]}x{image.size[1]}, not {width}x{height} as probed")
    return image.tobytes()


def frames_of(path: str, media_type: str, width: int, height: int, ffprobe: str = "ffprobe", ffmpeg: str = "ffmpeg") -> Iterator[tuple[float | None, int, int, bytes]]:
    """(time, width, height, RGB bytes) of a probed asset's frames, one held at a time; a failure names its stage."""
    if media_type == "image":
        with open(path, "rb") as f:
            yield None, width, height, read_image(f.read(), width, height)
        return
    times = keyframe_list(probe_keyframes(path, ffprobe))
    try:
        yield from KeyframeSampler().eval(path, width, height, json.dumps(times), ffmpeg)
    except (OSError, ValueError) as e:
        raise StageError("sampling", str(e)) from e


def decode_images(files: DataFrame) -> DataFrame:
    """files(path, content, width, height) as (path, width, height, rgb24, error): an image that can't be read has an error, the others go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.to_pydict()
            data, errors = [], []
            for path, content, w, h in zip(own["path"], own["content"], own["width"], own["height"], strict=True):
                try:
                    data.append(read_image(content, w, h))
                    errors.append(None)
                except StageError as e:
                    data.append(None)
                    errors.append(f"{path}: {e.message}")
            columns = {"path": pa.array(own["path"], pa.string()), "width": pa.array(own["width"], pa.int32()), "height": pa.array(own["height"], pa.int32()), "rgb24": pa.array(data, pa.binary()), "error": pa.array(errors, pa.string())}
            yield pa.RecordBatch.from_pydict(columns)

    return files.select("path", "content", "width", "height").mapInArrow(run, "path string, width int, height int, rgb24 binary, error string")


def checked_frames(frames: DataFrame) -> DataFrame:
    """Frames whose bytes fit their sides; others fail the run."""
    good = (F.col("width") > 0) & (F.col("height") > 0) & (F.octet_length("rgb24") == F.col("width") * F.col("height") * 3)
    return frames.filter(F.when(F.coalesce(good, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit("a frame must have three bytes for each pixel")).cast("boolean")))
