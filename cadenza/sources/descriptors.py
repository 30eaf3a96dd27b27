"""Asset descriptors: JSON documents that list boundaries and tracks."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.exprs import ROLE_LABELS

TRACK = T.StructType(
    [T.StructField(n, t) for n, t in (("id", T.StringType()), ("type", T.StringType()), ("format", T.StringType()), ("path", T.StringType()), ("codec", T.StringType()), ("width", T.LongType()), ("height", T.LongType()), ("frame_rate", T.StringType()), ("sample_rate", T.LongType()), ("channels", T.IntegerType()), ("language", T.StringType()), ("role", T.StringType()), ("tile_size", T.LongType()))]
)
DESCRIPTOR = T.StructType([T.StructField("$schema", T.StringType()), T.StructField("boundaries", T.ArrayType(T.LongType())), T.StructField("tracks", T.ArrayType(TRACK))])


TYPES = ("video", "audio", "text", "thumbnail")


def parsed(documents: DataFrame, content: str = "content") -> DataFrame:
    """documents with `asset`, the descriptor. An unknown key at the top, an
    unknown type or role, or broken JSON raises; unknown keys of tracks are
    passed over. No boundaries are empty ones; no language is `und`."""
    keys = F.json_object_keys(content)
    known = F.forall(keys, lambda k: k.isin("$schema", "boundaries", "tracks"))
    asset = F.when(F.coalesce(known, F.lit(False)), F.from_json(content, DESCRIPTOR, {"mode": "FAILFAST"})).otherwise(F.raise_error(F.lit("not a descriptor")))
    rows = documents.withColumn("asset", asset)
    good = F.forall("asset.tracks", lambda t: t["type"].isin(*TYPES) & (t["role"].isNull() | t["role"].isin(*ROLE_LABELS)))
    tracks = F.transform(F.when(F.coalesce(good, F.lit(True)), F.coalesce(F.col("asset.tracks"), F.array())).otherwise(F.raise_error(F.lit("unknown type or role"))), lambda t: t.withField("language", F.when(t["type"].isin("audio", "text"), F.coalesce(t["language"], F.lit("und")))))
    return rows.withColumn("asset", F.struct(F.col("asset.`$schema`").alias("$schema"), F.coalesce(F.col("asset.boundaries"), F.array().cast("array<bigint>")).alias("boundaries"), tracks.alias("tracks")))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, asset) of the descriptor files under path."""
    return parsed(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))).select("path", "asset")


def tracks_of(assets: DataFrame) -> DataFrame:
    """One row per track, with its descriptor's path, its place `pos` and `kind` (cmaf, webvtt or thumbnail)."""
    rows = assets.select(F.col("path").alias("descriptor"), F.posexplode("asset.tracks").alias("pos", "t")).select("descriptor", F.col("pos").cast("bigint").alias("pos"), "t.*")
    kind = F.when(F.col("type") == "thumbnail", "thumbnail").when(F.col("format") == "webvtt", "webvtt").otherwise("cmaf")
    return rows.withColumn("kind", kind)


def written_json(assets: DataFrame) -> DataFrame:
    """(path, content): pretty JSON, without null fields."""
    return assets.select("path", F.to_json("asset", {"pretty": "true", "ignoreNullFields": "true"}).alias("content"))


def json_schema() -> str:
    """The JSON Schema of a descriptor."""
    plain = {"string": {"type": "string"}, "integer": {"type": "integer", "minimum": 0}, "long": {"type": "integer", "minimum": 0}}

    def of(kind) -> dict:
        if isinstance(kind, T.ArrayType):
            return {"type": "array", "items": of(kind.elementType)}
        if isinstance(kind, T.StructType):
            return {"type": "object", "properties": {f.name: of(f.dataType) for f in kind.fields}}
        return dict(plain[kind.typeName()])

    top = of(DESCRIPTOR)
    track = top["properties"]["tracks"]["items"]
    track["properties"]["type"]["enum"] = list(TYPES)
    track["properties"]["role"]["enum"] = list(ROLE_LABELS)
    track["required"] = ["type"]
    return json.dumps({"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Asset", **top, "additionalProperties": False}, indent=2)


def parse_input(text: str) -> dict[str, str]:
    """`path[,language=..][,role=..]`; the last of repeated keys counts."""
    path, *rest = text.split(",")
    out = {"path": path}
    for part in rest:
        key, equals, value = part.partition("=")
        if not equals or key not in ("language", "role") or (key == "role" and value not in ROLE_LABELS):
            raise ValueError(f"not understood: {part!r}")
        if key == "language" and not re.fullmatch("[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*", value):
            raise ValueError(f"no language tag: {value!r}")
        out[key] = value
    if not path:
        raise ValueError("an input needs a path")
    return out
