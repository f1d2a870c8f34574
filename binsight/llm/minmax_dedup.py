"""Near-duplicate documents by min-max hashing.

Each of ``perms`` 64-bit permutations keeps both the minimum and the maximum
over a document's shingle set, so half as many hash evaluations fill the
signature.  Bands of ``rows`` values are the candidate buckets; links are
confirmed on the full shingle sets, and groups are the connected components of
the confirmed links.

* Documents with equal shingle sets collapse to one class before any
  comparison, however many copies there are.
* A bucket never lists its pairs.  First every member meets the bucket's
  smallest and its largest id; buckets whose members then share a component are
  finished.  In the others, the members outside the bucket's largest component
  are held against all members of other components, in blocks of bounded size
  that give out confirmed links only, so no candidate link between components
  is skipped.
* Defaults: 96 permutations, 192 values in 32 bands of 6.  A pair with
  similarity 0.8 shares no band with probability 6e-5, one with 0.9 below
  1e-10.

Defined results: null text, empty text and text without words have an empty
set, link with nothing and are kept.  Rows that repeat an id with the same text
get the same result; rows whose id is null never link (component null, kept
true).  A row whose set equals another's belongs to its class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import ODD, WordHashes, as_bytes, connected_components, cut, fresh, mix, shingle_hashes, ship, slices

_STEP = 1 << 15          # shingles hashed at a time (stays in cache)
_BLOCK_ROWS, _BLOCK_SHINGLES = 1024, 1 << 20          # of a bucket, held against each other at a time


def _doc_sets(batch: pa.RecordBatch, k: int, seen: WordHashes) -> Iterator[np.ndarray]:
    for body in batch.column("body"):
        words = body.as_py().lower().split()          # bytes: A-Z only, ASCII white space only
        h = np.array([seen[w] for w in words], dtype=np.uint64)
        yield np.unique(shingle_hashes(h, k))


def _constants(perms: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    a = rng.integers(0, 1 << 63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, perms, dtype=np.uint64)


def min_max_values(flat: np.ndarray, starts: np.ndarray, perms: int) -> np.ndarray:
    """(documents, 2 * perms): minimum and maximum of each permutation over each
    document's slice of ``flat``; ``starts`` has one entry per non-empty document."""
    a, b = _constants(perms)
    out = np.empty((len(starts), 2 * perms), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in range(perms):
            x = flat * a[p]
            x += b[p]
            x ^= x >> np.uint64(31)
            out[:, 2 * p] = np.minimum.reduceat(x, starts)
            out[:, 2 * p + 1] = np.maximum.reduceat(x, starts)
    return out


def _signer(k: int, perms: int, rows: int) -> Callable:
    def run(batches):
        seen, bands = WordHashes(), 2 * perms // rows
        for batch in slices(batches, 4 << 20):
            sets = list(_doc_sets(batch, k, seen))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            h1, h2 = np.zeros(len(sets), np.uint64), np.zeros(len(sets), np.uint64)
            keys = np.zeros((len(sets), bands), np.uint64)
            full = np.flatnonzero(sizes)
            i = 0
            with np.errstate(over="ignore"):
                while i < len(full):
                    j, n = i, 0
                    while j < len(full) and (j == i or n + sizes[full[j]] <= _STEP):
                        n += sizes[full[j]]
                        j += 1
                    own = full[i:j]
                    flat = np.concatenate([sets[d] for d in own])
                    starts = np.concatenate([[0], np.cumsum(sizes[own])[:-1]])
                    h1[own] = np.add.reduceat(mix(flat), starts)
                    h2[own] = np.add.reduceat(mix(flat ^ ODD), starts)
                    values = min_max_values(flat, starts, perms).reshape(len(own), bands, rows)
                    acc = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * ODD, (len(own), bands)).copy()
                    for r in range(rows):
                        acc = mix(acc ^ values[:, :, r])
                    keys[own] = acc
                    i = j
            flat_keys = keys[sizes > 0].reshape(-1).view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(sizes > 0, bands, 0))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat_keys))],
                names=["doc_id", "n", "h1", "h2", "bands"])
    return run


def _set_maker(k: int) -> Callable:
    def run(batches):
        seen = WordHashes()
        for batch in slices(batches, 4 << 20):
            sets = list(_doc_sets(batch, k, seen))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))],
                names=["doc_id", "shingles"])
    return run


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               k: int = 4, perms: int = 96, rows: int = 6) -> DataFrame:
    """(doc_id, n, h1, h2, bands): set size, 128-bit hash of the set, band keys."""
    ship(docs.sparkSession)
    return as_bytes(docs, id_col, text_col).mapInArrow(
        _signer(k, perms, rows), "doc_id long, n long, h1 long, h2 long, bands array<long>")


def _blocks(rows: Column, shingles: Column) -> Column:
    """Number of blocks for members that count so many rows and shingles."""
    return F.greatest(F.ceil(rows / _BLOCK_ROWS), F.ceil(shingles / _BLOCK_SHINGLES)).cast("long")


def _upto(n: str) -> Column:
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _cross_links(percent: int) -> Callable:
    """Links of a cell's outside members with the members of the bucket's largest
    component (``j`` >= 0) or with outside members of other components."""
    def run(cell: pa.Table) -> pa.Table:
        cell = cell.combine_chunks()
        doc, group, own = (cell.column(c).to_numpy() for c in ("doc_id", "g", "own"))
        outside = cell.column("outside").to_numpy(zero_copy_only=False)
        i, j = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        sets = cell.column("shingles").combine_chunks()
        size = np.diff(sets.offsets.to_numpy())
        names, flat = np.unique(sets.flatten().to_numpy(), return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(size)[:-1]])
        a, b, mark = [], [], np.zeros(len(names), dtype=bool)
        for x in np.flatnonzero(outside):
            at = slice(starts[x], starts[x] + size[x])
            mark[flat[at]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[flat[at]] = False
            linked = (100 * both >= percent * (size + size[x] - both)) & (group != group[x])
            if j >= 0:
                linked &= ~outside
            elif i != -1 - j:
                linked &= own != own[x]
            y = np.flatnonzero(linked)
            a += [doc[x]] * len(y)
            b += doc[y].tolist()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4,
                    percent: int = 80, perms: int = 96, rows: int = 6) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Linked: ``100 * |A & B| >= percent * |A | B|`` over sets of ``k``-word shingles.
    """
    sig = cut(signatures(docs, id_col, text_col, k, perms, rows))
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    classes = cut(sig.where(~alone).groupBy("h1", "h2")
                  .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min_by("bands", "doc_id").alias("bands")))
    placed = classes.select(F.col("rep").alias("doc_id"), "n", F.explode("bands").alias("key"))
    shared = (placed.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n")).alias("p"), F.max(F.struct("doc_id", "n")).alias("q"))
              .where("size > 1").select(fresh("key"), "size", "p", "q"))
    members = cut(placed.join(shared, "key"))
    # the texts behind a shared band, read once: full sets for every later check
    sets = cut(as_bytes(docs, id_col, text_col).join(members.select("doc_id").distinct(), "doc_id", "left_semi")
               .mapInArrow(_set_maker(k), "doc_id long, shingles array<long>"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        b = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = F.size(F.array_intersect("sa", "sb"))
        return (pairs.join(a, "a").join(b, "b")
                .where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))

    def pairs(frame: DataFrame, x: str, xn: str, y: str, yn: str) -> DataFrame:
        """Distinct unordered pairs whose set sizes allow the similarity."""
        return (frame.where(F.col(x) != F.col(y)).where(F.least(xn, yn) * 100 >= F.greatest(xn, yn) * percent)
                .select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct())

    ends = members.select("doc_id", "n", F.explode(F.array("p", "q")).alias("end"))
    links = cut(confirmed(pairs(ends, "doc_id", "n", "end.doc_id", "end.n")))
    groups = cut(connected_components(links))
    named = (members.where("size > 2").select("key", "doc_id", "n").join(groups.withColumnRenamed("id", "doc_id"), "doc_id", "left")
             .withColumn("g", F.coalesce("component", "doc_id")).drop("component"))
    split = (named.groupBy("key", "g").agg(F.count("*").alias("c"), F.sum("n").alias("n")).groupBy("key")
             .agg(F.count("*").alias("parts"), F.max(F.struct("c", "n", "g")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"))
             .where("parts > 1").select(fresh("key"), F.col("top.g").alias("top"), _blocks(F.col("c") - F.col("top.c"), F.col("n") - F.col("top.n")).alias("out"),
                                        _blocks(F.col("top.c"), F.col("top.n")).alias("in")))
    # cell (i, j): block i of the outside members with block j of the largest
    # component, or with block -1 - j of the outside members
    cells = (named.join(split, "key").withColumn("outside", F.col("g") != F.col("top"))
             .withColumn("own", F.pmod(F.xxhash64("doc_id", "key"), F.when(F.col("outside"), F.col("out")).otherwise(F.col("in"))))
             .withColumn("cell", F.explode(F.when(F.col("outside"), F.concat(
                 F.transform(_upto("in"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
                 F.transform(_upto("out"), lambda v: F.struct(F.least("own", v).alias("i"), (-1 - F.greatest("own", v)).alias("j")))))
                 .otherwise(F.transform(_upto("out"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))))
             .select("key", "cell.i", "cell.j", "own", "doc_id", "outside", "g"))
    more = (cells.join(sets, "doc_id").groupBy("key", "i", "j").applyInArrow(_cross_links(percent), "a long, b long").distinct())
    # components of components: only links between different groups are left
    own = groups.select(F.col("id"), F.col("component").alias("g"))
    joined = (more.join(own.select(F.col("id").alias("a"), F.col("g").alias("ga")), "a", "left").join(own.select(F.col("id").alias("b"), F.col("g").alias("gb")), "b", "left")
              .select(F.coalesce("ga", "a").alias("a"), F.coalesce("gb", "b").alias("b")))
    merged = cut(connected_components(joined))
    groups = (groups.select("id", F.col("component").alias("g")).join(merged.select(F.col("id").alias("g"), "component"), "g", "left")
              .select("id", F.coalesce("component", "g").alias("component"))
              .unionByName(merged).groupBy("id").agg(F.min("component").alias("component")))
    by_class = classes.select("h1", "h2", "rep").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        "h1", "h2", F.coalesce("component", "rep").alias("component"))
    linked = sig.where(~alone).select("doc_id", "n", "h1", "h2").join(by_class, ["h1", "h2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    single = sig.where(alone).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(single).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
