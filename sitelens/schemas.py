"""Explicit schemas for the canonical tables and the JSON report interchange.

Schemas are never inferred: report fields such as ``queue``, ``processed``
and ``finished`` are optional, and inference would make the schema depend on
the state a crawl was saved in.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

# Fetch log: one row per request made by a fetcher (input of every job).
RESPONSES = T.StructType([
    T.StructField("snapshot_id", T.IntegerType()),
    T.StructField("ord", T.LongType()),
    T.StructField("request_url", S),
    T.StructField("status", T.IntegerType()),
    T.StructField("location", S),
    T.StructField("content_type", S),
    T.StructField("last_modified_hdr", S),
    T.StructField("body", T.BinaryType()),
])

# One report asset, fields in the order the report writes them.
ASSET = T.StructType([
    T.StructField("url", S),
    T.StructField("last_modified", S),
    T.StructField("data_mime", S),
    T.StructField("charset", S),
    T.StructField("hash", S),
    T.StructField("references", T.ArrayType(S)),
])

META = T.StructType([
    T.StructField("url", S),
    T.StructField("started", S),
    T.StructField("finished", S),
    T.StructField("queue", T.ArrayType(S)),
    T.StructField("processed", T.ArrayType(S)),
    T.StructField("version", S),
    T.StructField("settings", T.MapType(S, S)),
])

REPORT = T.StructType([
    T.StructField("meta", META),
    T.StructField("assets", T.ArrayType(ASSET)),
])

CONTENT = T.StructType([
    T.StructField("hash", S),
    T.StructField("body", T.BinaryType()),
])

ASSET_COLUMNS = [f.name for f in ASSET.fields]
