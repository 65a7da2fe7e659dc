"""Typed headerless CSV, CSV with header, JSON Lines and Parquet readers and writers, manifests and class names."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schema as S

# What register_views looks for.
TABLES = ("detections", "tracks", "videos", "signals", "intervals", "labels", "time_map")


def read_table(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, header: bool = False, video_from_name: str | None = None) -> DataFrame:
    """CSV with a fixed schema; malformed rows fail. video_from_name: a suffix that, cut off the file's stem, leaves
    the video id, added as video_id (one read over many files)."""
    df = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path if isinstance(path, str) else list(path))
    if video_from_name is None:
        return df
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "")
    return df.select(F.regexp_replace(F.url_decode(stem), f"{video_from_name}$", "").alias("video_id"), *schema.names)


def read_detections(spark: SparkSession, path, video_from_name: str | None = None) -> DataFrame:
    return read_table(spark, path, S.DETECTION, video_from_name=video_from_name)


def read_tracks(spark: SparkSession, path, interpolated: bool = False, video_from_name: str | None = None) -> DataFrame:
    """Headerless track file; the same reader serves every later step."""
    return read_table(spark, path, S.TRACK_INTERP if interpolated else S.TRACK, video_from_name=video_from_name)


def read_tracks_int(spark: SparkSession, path) -> DataFrame:
    """Tracks with whole coordinates; a fractional one is an error."""
    df = read_tracks(spark, path)
    whole = lambda c: F.when(F.col(c) == F.floor(c), F.col(c).cast("int")).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c} has a fraction")).cast("int")).alias(c)
    return df.select(*[whole(c) if c in ("x", "y", "w", "h") else F.col(c) for c in df.columns])


def read_speeds(spark: SparkSession, path) -> DataFrame:
    return read_table(spark, path, S.SPEED)


def read_segmentation(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(S.SEGMENTATION).option("mode", "FAILFAST").json(path)


def read_draw(spark: SparkSession, path: str) -> DataFrame:
    """Overlay rows from CSV with header; coords and color may be written with round or square brackets."""
    raw = spark.read.option("ignoreTrailingWhiteSpace", False).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    listed = lambda c: F.translate(F.col(c), "()", "[]")
    return raw.select(
        F.col("frame").cast("int").alias("frame"),
        "type",
        F.from_json(listed("coords"), S.DRAW["coords"].dataType).alias("coords"),
        F.from_json(listed("color"), S.DRAW["color"].dataType).alias("color"),
        F.col("size").cast("double").alias("size"),
        F.col("thick").cast("int").alias("thick"),
        "desc",
        (F.lower("fill").cast("boolean") if "fill" in raw.columns else F.lit(False)).alias("fill"),
        (F.col("alpha").cast("double") if "alpha" in raw.columns else F.lit(0.0)).alias("alpha"),
    )


def write_table(df: DataFrame, path: str, header: bool = False, partition_by: Sequence[str] = ()) -> None:
    """CSV, overwritten; headerless unless told otherwise, also when empty."""
    writer = df.write.mode("overwrite").option("header", header).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("escape", '"')
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_draw(df: DataFrame, path: str) -> None:
    """Overlay rows as CSV with header; nested columns as JSON."""
    write_table(df.withColumns({c: F.to_json(c) for c in ("coords", "color")}), path, header=True)


def write_segmentation(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_time_map(df: DataFrame, path: str) -> None:
    """One folder per video, with header."""
    write_table(df, path, header=True, partition_by=["video"])


# The class names of the usual detection models, by number.
CLASS_NAMES = """person, bicycle, car, motorbike, aeroplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench,
bird, cat, dog, horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball,
kite, baseball bat, baseball glove, skateboard, surfboard, tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich,
orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, sofa, pottedplant, bed, diningtable, toilet, tvmonitor, laptop, mouse, remote, keyboard,
cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush"""


def _class_lines(spark: SparkSession, path: str | None) -> list[str]:
    if not path:
        return [" ".join(n.split()) for n in CLASS_NAMES.split(",")]
    names = [r["value"] for r in spark.read.text(path, wholetext=True).collect()]
    lines = names[0].splitlines() if names else []
    if not lines:
        raise ValueError(f"the file of class names is empty: {path}")
    return [n.strip() for n in lines]


def load_class_dict(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, name) by line number; blank lines are left out but keep their number. One file of names, read on the driver; without
    one the usual 80 classes. An empty file raises ValueError."""
    return spark.createDataFrame([(k, n) for k, n in enumerate(_class_lines(spark, path)) if n], "id int, name string")


def load_classes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(id, name) by position among the lines that are not blank; without a file the usual 80 classes."""
    names = [n for n in _class_lines(spark, path) if n]
    if not names:
        raise ValueError(f"the file of class names is empty: {path}")
    return spark.createDataFrame(list(enumerate(names)), "id int, name string")


def pair_files(spark: SparkSession, detections: Sequence[str], videos: Sequence[str] | None = None) -> DataFrame:
    """(position, detections, video): files paired by position, without videos null. Lists of different length raise
    ValueError."""
    if videos is not None and len(videos) != len(detections):
        raise ValueError("there must be as many videos as detection files")
    rows = [(k, d, videos[k] if videos else None) for k, d in enumerate(detections)]
    return spark.createDataFrame(rows, "position int, detections string, video string")


def register_views(spark: SparkSession, folder: str, names: Sequence[str] = TABLES) -> list[str]:
    """Temporary views for spark.sql of the typed tables <folder>/<name> that are there: detections and tracks as text tables,
    any other name as Parquet. Returns the names registered."""
    found = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            read = {"detections": read_detections, "tracks": read_tracks}.get(name)
            df = read(spark, path.toString()) if read else spark.read.parquet(path.toString())
            df.createOrReplaceTempView(name)
            found.append(name)
    return found


def batch_manifest(sources: DataFrame, suffix: str, cut: str = "", done: DataFrame | None = None, overwrite: bool = False) -> DataFrame:
    """Rows (path) with stem and the output name: stem without the ending `cut`, plus suffix. Outputs listed in
    done (output) are skipped unless overwritten."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    out = sources.withColumn("stem", F.regexp_replace(stem, f"{cut}$", "") if cut else stem)
    out = out.withColumn("output", F.concat("stem", F.lit(suffix)))
    return out if done is None or overwrite else out.join(done, "output", "left_anti")


def download_file(url: str, destination: str, chunk: int = 8192) -> None:
    """Fetch a file in chunks, on the driver."""
    Path(destination).parent.mkdir(parents=True, exist_ok=True)
    with urlopen(url) as source, open(destination, "wb") as target:  # noqa: S310
        while block := source.read(chunk):
            target.write(block)
