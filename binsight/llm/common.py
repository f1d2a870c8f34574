"""Helpers shared by the operators: table access, shipping of the package to
Python workers, cut lineage, connected components, word and shingle hashes."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: rows and bytes of a record batch for a Python worker, unless the session sets its own: a
#: worker and the JVM beside it hold a batch as a whole, and texts may be long
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": (None, "8m")}


def ship(spark: SparkSession) -> None:
    """Make the session ready for Python workers: bounded record batches, and
    this package sent to the executors once per application, so that their
    workers import it whatever their working folder is."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, None) in (default, "9223372036854775807", "64MB", "268435456b"):
            spark.conf.set(key, ours)
    sc = spark.sparkContext
    if getattr(sc, "_binsight_shipped", None):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    top = os.path.dirname(root)
    if not os.path.isdir(root):      # already running from a shipped archive
        return
    target = os.path.join(tempfile.mkdtemp(prefix="binsight-ship-"), "binsight_ship.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, top))
    sc.addPyFile(target)
    sc._binsight_shipped = target


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder lineage is cut in: the one the cluster names in
    ``spark.checkpoint.dir``.  Only a local session where it is unset gets one of
    its own; on a cluster an unset folder is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="binsight-ckpt-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage:
    a lost executor re-reads the files instead of recomputing the past."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """``cut`` by a Parquet table in the shared checkpoint folder, for rows that are
    read more than once and by few of their columns."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, body): the id as long and the UTF-8 bytes of the text (null text: empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


def slices(batches: Iterator[pa.RecordBatch], max_bytes: int = 8 << 20, body: str = "body") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one holds at most ``max_bytes`` of text (or
    one row): memory per step does not depend on how long the texts are."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        size = pc.binary_length(batch.column(body)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(size) // max_bytes
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch.slice(a, b - a)


# ------------------------------------------------------------ components

def fresh(name: str):
    """A key column that Catalyst no longer knows to be partitioned: joining on it
    puts a plain exchange on this side, so that adaptive execution may split a
    skewed partition of the other side."""
    return (F.col(name) + F.lit(0)).alias(name)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component): every id that occurs in ``edges`` (a, b: longs) with the
    smallest id reachable from it.

    Alternating large-star / small-star rounds.  A round is two map-side combined
    ``min`` aggregations and two equi-joins whose skewed partitions can be split,
    so a hub with any number of neighbours is only ever summed or split.  Null ids
    and self links are ignored; no edges give no rows.
    """
    def oriented(a, b):
        return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]

    e = cut(edges.where("a is not null and b is not null and a <> b")
            .select(*oriented(F.col("a"), F.col("b"))).distinct())
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == seen:
            break
        seen = now
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u"), F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low2 = large.groupBy("u").agg(F.min("v").alias("m")).select(fresh("u"), "m")
        small = (large.join(low2, "u")
                 .select(F.explode(F.array(F.struct(*oriented(F.col("v"), F.col("m"))), F.struct("u", F.col("m").alias("v")))).alias("x"))
                 .select("x.*").where("u <> v"))
        # no more edges than before: one file for every 100,000 of them at most
        e = cut(small.distinct().coalesce(max(1, now[0] // 100_000)))
    return (e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")),
                                       F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("x"))
            .select("x.*").distinct())


# ------------------------------------------------------------ hashing

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)      # 64-bit finaliser constants
ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * M1
    x = x ^ (x >> np.uint64(33))
    x = x * M2
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    def __init__(self, bound: int = 150_000):
        super().__init__()
        import xxhash
        self._hash, self._bound = xxhash.xxh64_intdigest, bound

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._bound:
            self.clear()
        h = self[word] = self._hash(word)
        return h


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (the whole sequence when it
    is shorter; empty for no words), in order, repeats included."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    with np.errstate(over="ignore"):
        acc = words[: n - k + 1].copy()
        for i in range(1, k):
            acc = acc * ODD + words[i: n - k + 1 + i]
            acc ^= acc >> np.uint64(29)
        return mix(acc + np.uint64(k))


def hashed_vectors(bodies: list[bytes], n: int, buckets: int) -> np.ndarray:
    """(documents, buckets): unit vectors of the square roots of hashed counts of
    ``n`` consecutive bytes; zero for texts of fewer bytes.  ``buckets``: a power of two."""
    flat = np.frombuffer(b"".join(bodies), dtype=np.uint8).astype(np.uint32)
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    out = np.zeros((len(bodies), buckets))
    if len(flat) >= n:
        h = np.zeros(len(flat) - n + 1, dtype=np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= flat[i:len(flat) - n + 1 + i]
        h *= np.uint32(0x9E3779B1)
        h >>= np.uint32(32 - (buckets.bit_length() - 1))
        grams = np.maximum(size - n + 1, 0)
        start = np.cumsum(size) - size
        place = np.cumsum(grams) - grams
        at = np.arange(int(grams.sum())) + np.repeat(start - place, grams)     # grams within one document only
        cell = h[at].astype(np.int64) + np.repeat(np.arange(len(bodies)) * buckets, grams)
        out = np.sqrt(np.bincount(cell, minlength=len(bodies) * buckets).reshape(len(bodies), buckets))
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


# ------------------------------------------------------------ classifiers

def held_out(id_col: str):
    """crc32 of the id as text, modulo 4, is 2 (false for a null id)."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def labelled_sample(rows: DataFrame, id_col: str, label_col: str, per_label: int) -> DataFrame:
    """(id, label) of at most ``per_label`` rows per label on average and never more
    than ``per_label`` times the number of labels: the ids with the smallest hashes
    among the rows outside the held-out part.  Only ids and labels are moved."""
    known = (rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), held_out(id_col).alias("out"))
             .where("id is not null and label is not null and not out").drop("out").withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1 << 30))))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return known.select("id", "label").limit(0)
    part = F.lit(False)
    for label, n in counts.items():
        part = part | ((F.col("label") == F.lit(label)) & (F.col("h") < int(min(1.0, per_label / n) * (1 << 30))))
    return known.where(part).distinct().orderBy("h", "id").limit(per_label * len(counts)).select("id", "label")
