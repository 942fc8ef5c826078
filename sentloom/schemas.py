"""Explicit schemas of the tables that cross a file boundary."""

from pyspark.sql import types as T

_IDS = T.ArrayType(T.LongType())
_FLOATS = T.ArrayType(T.FloatType())

SENTENCE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("pos", T.LongType()),
        T.StructField("text", T.StringType()),
    ]
)
VOCAB = T.StructType(
    [T.StructField("word", T.StringType()), T.StructField("id", T.IntegerType())]
)
WORD_VEC = T.StructType(
    [
        T.StructField("word", T.StringType()),
        T.StructField("id", T.IntegerType()),
        T.StructField("v", _FLOATS),
    ]
)

# Record kinds. Field names are fixed values: readers of existing tables rely on them.
RECORDS = {
    "triple": T.StructType(
        [
            T.StructField("decode_pre", _IDS),
            T.StructField("encode", _IDS),
            T.StructField("decode_post", _IDS),
        ]
    ),
    "clip": T.StructType(
        [
            T.StructField("encode", _IDS),
            T.StructField("clip", _FLOATS),
            T.StructField("nb_frames", T.LongType()),
        ]
    ),
    "image": T.StructType(
        [T.StructField("sentence", _IDS), T.StructField("image", _FLOATS)]
    ),
    "pair": T.StructType([T.StructField("s1", _IDS), T.StructField("s2", _IDS)]),
    "label": T.StructType(
        [T.StructField("encode", _IDS), T.StructField("feature", _FLOATS)]
    ),
}
