"""Archive lookup (V1, V2): path -> stored body, as batch joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.functions import mime as M
from sitelens.functions import urls as U

# Characters of a pathname that the URL parser percent-encodes
# (besides non-ASCII and controls).
_PATH_ESCAPES = [(" ", "%20"), ('"', "%22"), ("<", "%3C"), (">", "%3E"), ("`", "%60"),
                 ("{", "%7B"), ("}", "%7D")]


def encoded_path(path: Column) -> Column:
    """A pathname as the URL parser serialises it (escapes already present are kept)."""
    p = U.pct_encode_nonascii(path)
    for ch, esc in _PATH_ESCAPES:
        p = F.replace(p, F.lit(ch), F.lit(esc))
    return p


def path_index(assets: DataFrame) -> DataFrame:
    """V1: pathname -> (hash, data_mime) of the last asset with that path (host and query ignored).

    The key is made non-nullable (a url that does not parse gives ''; no request
    has an empty pathname): for a nullable derived key Spark infers an
    ``isnotnull`` filter on the joining side and pushes it down to the scan,
    which would evaluate the whole key expression a second time there.
    """
    a = assets.select("ord", "hash", "data_mime",
                      F.coalesce(encoded_path(U.url_path(F.col("url"))), F.lit("")).alias("path"))
    return (a.groupBy("path").agg(F.max_by(F.struct("hash", "data_mime"), F.col("ord")).alias("v"))
            .select("path", "v.hash", "v.data_mime"))


def resolve_requests(requests: DataFrame, assets: DataFrame, content: DataFrame) -> DataFrame:
    """V2: per requested path: 404 (unknown path or null hash), 500 (hash not stored), else 200.

    ``content`` is the store (hash, body). Content type defaults to
    application/octet-stream when the asset's MIME is null or empty.
    """
    idx = path_index(assets)
    req = requests.withColumn("_p", F.coalesce(encoded_path(F.col("path")), F.lit("")))
    stored = content.select(F.col("hash").alias("_h"), F.lit(True).alias("_stored")).dropDuplicates(["_h"])
    j = (req.join(idx.withColumnRenamed("path", "_p"), "_p", "left")
         .join(stored, F.col("hash") == F.col("_h"), "left"))
    status = (F.when(F.col("hash").isNull() | (F.col("hash") == ""), F.lit(404))
              .when(F.col("_stored").isNull(), F.lit(500)).otherwise(F.lit(200)))
    ctype = F.when(status == 200, F.coalesce(F.when(F.col("data_mime") != "", F.col("data_mime")),
                                             F.lit(M.DEFAULT_MIME)))
    return j.select("path", status.alias("status"), ctype.alias("content_type"),
                    F.when(status != 404, F.col("hash")).alias("hash"))
