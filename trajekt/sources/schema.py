"""Table schemas, and the sentinels kept at the border."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(text: str) -> T.StructType:
    kinds = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split(":") for x in text.split())])


DETECTION = _struct("frame:int res:int x:double y:double w:double h:double conf:double class:int")
TRACK = _struct("frame:int track:int x:double y:double w:double h:double score:double cls:int r3:int r4:int")
TRACK_INTERP = _struct("frame:int track:int x:double y:double w:double h:double score:double cls:int interp:int r4:int")
SPEED = _struct("c0:int c1:int c2:int")
SIGNAL_DETECTION = _struct("frame:int signal:int detection:int")
SIGNAL_INTERVAL = _struct("signal:int status:int beg_frame:int end_frame:int")
TIME_MAP = _struct("frame:long unix_time:long video:string")
RECLASS = _struct("track:int cls:int avg_score:double")
VIDEOS = _struct("video_id:string fps:double n_frames:int width:int height:int")
DRAW = T.StructType(
    [
        T.StructField("frame", T.IntegerType()),
        T.StructField("type", T.StringType()),
        T.StructField("coords", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("color", T.ArrayType(T.IntegerType())),
        T.StructField("size", T.DoubleType()),
        T.StructField("thick", T.IntegerType()),
        T.StructField("desc", T.StringType()),
        T.StructField("fill", T.BooleanType()),
        T.StructField("alpha", T.DoubleType()),
    ]
)
SEGMENTATION = T.StructType(
    [
        T.StructField("frame", T.IntegerType()),
        T.StructField("res", T.IntegerType()),
        T.StructField("class", T.ArrayType(T.DoubleType())),
        T.StructField("conf", T.ArrayType(T.DoubleType())),
        T.StructField("mask", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    ]
)
