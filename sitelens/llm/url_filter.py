"""URL filter over a sorted digest array.

The rules (host, path, verdict) are turned into sorted 64-bit xxhash keys of ``host + path``. The key array
and the full rule strings are written once to the shared folder, sent to every executor as a file of the
job, and memory-mapped there: all tasks of a machine share its pages, and a list of any length costs no heap.
Each url's candidate keys (every domain suffix of its host x the path prefixes of the lengths that occur
among the rules) are probed with one vectorised binary search per batch; a hit counts only if the stored
string equals the candidate, so hash collisions cannot decide.

A rule fits its host and all subdomains if the url's path starts with the rule's path; the longest fitting
rule wins. Urls that no rule fits get the default verdict. A null url, or one without ``://``, has an empty
host and path and fits no rule. Repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import mmap
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir

#: (host, path, verdict): fixed values of the query's contract
CONTRACT_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def digest_file(rules: Sequence[tuple[str, str, str]]) -> bytes:
    """Header [n, path lengths], sorted keys, entry offsets, entries (verdict byte + host + NUL + path)."""
    by_text = {(h, p): v for h, p, v in rules}
    items = sorted((xxhash.xxh64_intdigest(f"{h}{p}"), h, p, v) for (h, p), v in by_text.items())
    entries = [(b"\1" if v == "block" else b"\0") + h.encode() + b"\0" + p.encode() for _, h, p, v in items]
    lengths = sorted({len(p) for _, _, p, _ in items})
    head = np.array([len(items), len(lengths), *lengths], "<u8").tobytes()
    keys = np.array([k for k, *_ in items], "<u8").tobytes()
    offs = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype("<u8").tobytes()
    return head + keys + offs + b"".join(entries)


def publish(spark: SparkSession, data: bytes) -> str:
    """Put the digest file into the shared folder and hand it to the executors; returns its name."""
    name = f"url-digest-{uuid.uuid4().hex}.bin"
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


class DigestArray:
    """The memory-mapped array; ``probe`` looks up many candidate strings at once."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, m = (int(x) for x in np.frombuffer(self.map, "<u8", 2))
        self.path_lengths = [int(x) for x in np.frombuffer(self.map, "<u8", m, 16)]
        at = 16 + 8 * m
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.offs = np.frombuffer(self.map, "<u8", n + 1, at + 8 * n)
        self.base = at + 8 * n + 8 * (n + 1)

    def entry(self, i: int) -> bytes:
        return self.map[self.base + int(self.offs[i]):self.base + int(self.offs[i + 1])]

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[int, bool] | None]:
        """For each (host, path) candidate: (entry, block?) if that very rule is stored."""
        want = np.fromiter((xxhash.xxh64_intdigest(h + p) for h, p in zip(hosts, paths)), np.uint64, len(hosts))
        at = np.searchsorted(self.keys, want)
        found: list[tuple[int, bool] | None] = [None] * want.size
        for i in np.flatnonzero((at < self.keys.size) & (self.keys[np.minimum(at, max(0, self.keys.size - 1))] == want)
                                if self.keys.size else np.zeros(want.size, bool)):
            text, j = hosts[i].encode() + b"\0" + paths[i].encode(), int(at[i])
            while j < self.keys.size and self.keys[j] == want[i]:   # equal keys: compare the stored strings
                entry = self.entry(j)
                if entry[1:] == text:
                    found[i] = (j, entry[:1] == b"\1")
                    break
                j += 1
        return found


_OPEN: dict[str, DigestArray] = {}


def _opened(name: str) -> DigestArray:
    path = SparkFiles.get(name)
    if path not in _OPEN:
        _OPEN[path] = DigestArray(path)
    return _OPEN[path]


def _suffixes(host: str) -> list[str]:
    parts = host.split(".")
    return [".".join(parts[i:]) for i in range(len(parts))]


def judge(array: DigestArray, hosts: list[str], paths: list[str], default: str):
    """(rule, verdict) of each (host, path): the candidates of all urls are probed together."""
    owner, cand_h, cand_p = [], [], []
    for i, (h, p) in enumerate(zip(hosts, paths)):
        if not h:
            continue
        prefixes = [p[:n] for n in array.path_lengths if n <= len(p)]
        for s in _suffixes(h):
            for q in prefixes:
                owner.append(i)
                cand_h.append(s)
                cand_p.append(q)
    best: list[tuple[int, int, str, bool] | None] = [None] * len(hosts)
    for i, s, q, hit in zip(owner, cand_h, cand_p, array.probe(cand_h, cand_p)):
        if hit is not None:
            rank = (len(s) + len(q), len(s), s + q, hit[1])
            if best[i] is None or rank > best[i]:
                best[i] = rank
    rules = [b[2] if b else None for b in best]
    verdicts = [("block" if b[3] else "allow") if b else default for b in best]
    return rules, verdicts


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id",
                url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row's url."""
    for h, p, v in rules:
        if v not in ("allow", "block") or "\0" in h + p:
            raise ValueError(f"bad rule {h!r} {p!r} {v!r}")
    name = publish(df.sparkSession, digest_file(rules))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rest = F.expr("if(instr(u, '://') > 0, substring(u, instr(u, '://') + 3), '')")
    parts = (df.select(F.col(id_col).alias("key"), url.alias("u")).withColumn("rest", rest)
             .withColumn("host", F.regexp_extract("rest", r"^([^/?#]*)", 1))
             .withColumn("path", F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1))
             .select("key", F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"), "path"))
    key_type = parts.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(name)
        for b in batches:
            rule, verdict = judge(array, b.column(1).to_pylist(), b.column(2).to_pylist(), default)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rule, pa.string()),
                                              pa.array(verdict, pa.string())], ["key", "host", "path", "rule", "verdict"])

    out = parts.mapInArrow(run, f"key {key_type}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("key", id_col)
