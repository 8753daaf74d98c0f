"""URL filter by a sorted array of 64-bit digests, memory-mapped by the workers."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meshlag.llm.util import small_batches

#: Rule (host, then path from its first slash) -> verdict.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: Rules that are put into one digest file; longer lists are probed file by file.
FILE_RULES = 20_000_000


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


#: (application, file) pairs that Spark serves already: it takes a name once.
_served: set[tuple[str, str]] = set()


def publish(spark: SparkSession, rules: dict[str, str]) -> list[str]:
    """Makes the digest files and hands them to every executor; returns their names.

    The driver writes a file next to itself and Spark's own file server brings it to each executor, so no
    folder has to be shared.

    A file holds n, then the sorted uint64 digests, the offsets of the stored rules, their verdicts (1 block)
    and the rules themselves. Its name is the digest of its content, so equal lists are sent once.
    """
    names = []
    items = sorted(rules.items())
    for k in range(0, len(items), FILE_RULES):
        part = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), int(v == "block")) for r, v in items[k : k + FILE_RULES])
        n = len(part)
        offsets = np.concatenate([[0], np.cumsum([len(r) for _, r, _ in part])]).astype("<u8")
        body = np.array([n], "<u8").tobytes() + np.array([d for d, _, _ in part], "<u8").tobytes() + offsets.tobytes() + bytes(v for _, _, v in part) + b"".join(r for _, r, _ in part)
        name = f"urlrules-{hashlib.sha256(body).hexdigest()[:32]}.bin"
        names.append(name)
        if (key := (spark.sparkContext.applicationId, name)) not in _served:
            path = os.path.join(tempfile.mkdtemp(prefix="urlrules-"), name)
            with open(path, "wb") as f:
                f.write(body)
            spark.sparkContext.addFile(path)
            _served.add(key)
    return names


class DigestTable:
    """A memory-mapped digest file: pages are shared by the workers of a machine and read as they are probed."""

    def __init__(self, path: str):
        n = int(np.fromfile(path, "<u8", 1)[0])
        self.raw = np.memmap(path, np.uint8, "r")
        self.digests = np.memmap(path, "<u8", "r", 8, n)
        self.offsets = np.memmap(path, "<u8", "r", 8 + 8 * n, n + 1)
        self.block = np.memmap(path, np.uint8, "r", 16 + 16 * n, n)
        self.texts = 16 + 17 * n

    def probe(self, keys: list[bytes]) -> list[tuple[int, bool]]:
        """(index of the key, blocks?) of every key that is a stored rule."""
        want = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        at = np.searchsorted(self.digests, want)
        near = np.flatnonzero((at < len(self.digests)) & (self.digests[np.minimum(at, len(self.digests) - 1)] == want)) if len(self.digests) else []
        out = []
        for i in near:
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == want[i]:  # equal digests stand side by side
                a, b = self.texts + int(self.offsets[j]), self.texts + int(self.offsets[j + 1])
                if self.raw[a:b].tobytes() == keys[i]:
                    out.append((int(i), bool(self.block[j])))
                    break
                j += 1
        return out


_open: dict[str, DigestTable] = {}


def filter_urls(pages: DataFrame, rules: dict[str, str] | None = None, default: str = "allow", id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Returns id, host, path, rule (the longest that fits, else null) and verdict (the rule's, else `default`).

    A rule fits its host and all subdomains if the path starts with the rule's path. A url without :// or a
    null one has empty host and path, and the default verdict. A host is probed by as many of its last labels
    as the longest rule has, so very long urls cost their length once. Rows that share an id keep a row each;
    an empty table gives an empty table, an empty rule list the default everywhere; other columns are left
    out, whatever their names.
    """
    spark = pages.sparkSession
    rules = {"".join(split_rule(r)): v for r, v in (RULES if rules is None else rules).items()}
    if set(rules.values()) - {"allow", "block"}:
        raise ValueError("a verdict is allow or block")
    small_batches(spark)
    names = publish(spark, rules)
    path_lengths = sorted({len(split_rule(r)[1]) for r in rules})
    deepest = max((split_rule(r)[0].count(".") + 1 for r in rules), default=0)

    @F.arrow_udf("struct<rule string, block boolean>")
    def judge(hosts: pa.Array, paths: pa.Array) -> pa.Array:
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts.to_pylist(), paths.to_pylist(), strict=True)):
            if not host:
                continue
            labels = host.rsplit(".", deepest)  # no rule has more labels, so no longer suffix is made
            for k in range(max(0, len(labels) - deepest), len(labels)):
                suffix = ".".join(labels[k:])
                for n in path_lengths:
                    if n <= len(path):
                        keys.append((suffix + path[:n]).encode())
                        owner.append(i)
        best: dict[int, tuple[bytes, bool]] = {}
        for name in names:
            if name not in _open:
                _open[name] = DigestTable(SparkFiles.get(name))
            for k, block in _open[name].probe(keys):
                if len(keys[k]) > len(best.get(owner[k], (b"",))[0]):
                    best[owner[k]] = (keys[k], block)
        found = [best.get(i) for i in range(len(hosts))]
        return pa.StructArray.from_arrays([pa.array([x and x[0].decode() for x in found], pa.string()), pa.array([x and x[1] for x in found], pa.bool_())], ["rule", "block"])

    rows = pages.select(F.col(id_col).alias(id_col), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("_j", judge("host", "path"))
    return rows.select(id_col, "host", "path", F.col("_j.rule").alias("rule"), F.coalesce(F.when(F.col("_j.block"), F.lit("block")).when(~F.col("_j.block"), F.lit("allow")), F.lit(default)).alias("verdict"))
