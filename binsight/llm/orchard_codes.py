"""Compression of vectors to four code bytes, with Orchard's search for the nearest entry.

A vector is cut into consecutive parts; each part position has a codebook, and a
part is coded by the number of its nearest entry.  Components are integers
(``floor(scale * x)``), so distances, means and codes are exact and the same on
any number of tasks.

*Search.*  Every entry keeps a list of the others, sorted by their distance from
it.  A query starts at the nearest of a few pivot entries and reads the list of
its current entry: an entry nearer than the current one makes the query jump to
that entry's list; entries it has seen are marked and skipped; beyond twice the
current distance nothing can be nearer (triangle inequality), so the search
ends there.  Entries at exactly twice the distance are still read, and among
equal distances the lower number wins, so the answer is that of the full
comparison.  The queries of a record batch advance together, a block of their
lists at a time.

*Training.*  Each round codes every part and replaces an entry by the floor of
the mean of its parts.  Tasks hand on one row of sums per entry (1,024 rows of a
task), Spark adds them up, and the driver holds the codebooks alone (256 entries
a part).  The integers are written once to the shared folder and read by every
round.

Defined results: rows whose vector is null or holds null or non-finite
components are dropped, and so are vectors of another length than that of the
smallest id (of the smallest vector among rows without any id).  Lengths that
the number of parts does not divide are filled with zeros.  Components beyond
2^24 / scale in size are cut there, so that errors fit a long.  Ids that repeat
give one entry each, made of the smallest of their vectors; rows without an id
are coded but start no entry; with fewer ids than entries the codebooks are that
much smaller, and without any the smallest vector makes the only entry.  Null
labels are one label.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import ship, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: size of a component at which it is cut; smaller for vectors of over 512 components
LIMIT = 1 << 22
#: queries that advance together, and entries of a list that they read in a step
_QUERIES, _STEP = 1024, 32
_PIVOTS = 16
_NEVER = np.iinfo(np.int64).max


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis (exact in the arrays' type)."""
    d = x - y
    return np.einsum("...i,...i->...", d, d)


class Orchard:
    """The distance-sorted neighbour lists of a codebook (entries, dimensions)."""

    def __init__(self, entries: np.ndarray):
        entries = np.asarray(entries, dtype=np.int64)
        self.entries = entries
        n = len(entries)
        far = _squared(entries[:, None, :], entries[None, :, :])
        lists = np.argsort(far, axis=1, kind="stable")
        # lists in blocks of _STEP entries, one row a block; what fills the last is out of any reach
        self.blocks, fill = -(-n // _STEP), ((0, 0), (0, -n % _STEP))
        self.lists = np.pad(lists, fill).reshape(-1, _STEP)
        self.far = np.pad(np.take_along_axis(far, lists, axis=1), fill, constant_values=_NEVER).reshape(-1, _STEP)
        # pivots: first entry, then always the entry furthest from those chosen
        pivots, near = [0], far[0].copy()
        while len(pivots) < min(_PIVOTS, n):
            pivots.append(int(near.argmax()))
            near = np.minimum(near, far[pivots[-1]])
        self.pivots = np.array(sorted(set(pivots)))
        self.read = 0            # distances computed, for tests and measurements

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest entry of each query (rows of integers)."""
        code, best = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for s in range(0, len(queries), _QUERIES):
            code[s:s + _QUERIES], best[s:s + _QUERIES] = self._block(queries[s:s + _QUERIES])
        return code, best

    def _block(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # doubles add faster; they are used where all sums are exact in them
        n, m = len(self.entries), max(int(np.abs(q).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        kind = np.float64 if 4 * m * m * max(q.shape[1], 1) < 1 << 53 else np.int64
        q, entries = q.astype(kind), self.entries.astype(kind)
        rows, length, norm = np.arange(len(q)), (q * q).sum(axis=1), (entries * entries).sum(axis=1)
        seen = np.zeros((len(q), n), dtype=bool)
        seen[:, self.pivots] = True
        start = length[:, None] + norm[self.pivots] - 2 * (q @ entries[self.pivots].T)
        at = start.argmin(axis=1)               # the first of equal ones: pivots ascend
        current, best = self.pivots[at], start[rows, at].astype(np.int64)
        place, live, marks = np.zeros(len(q), np.int64), rows, seen.reshape(-1)
        self.read += start.size
        while len(live):
            at = current[live] * self.blocks + place[live]
            x = self.lists.take(at, axis=0)
            # beyond twice the current distance (four times its square) the list ends
            within = self.far.take(at, axis=0) <= 4 * best[live][:, None]
            mark = x + (live * n)[:, None]
            fresh = within & ~marks.take(mark)
            marks[mark[fresh]] = True
            self.read += int(fresh.sum())
            d = (norm.take(x) + length[live][:, None] - 2 * np.matmul(entries.take(x, axis=0), q[live][:, :, None])[:, :, 0]).astype(np.int64)
            # the nearest of what each query read, the lower number among equals
            low = np.where(fresh, d * n + x, _NEVER).min(axis=1)
            better = low < best[live] * n + current[live]
            jump = live[better]
            place[live] += 1
            current[jump], best[jump], place[jump] = low[better] % n, low[better] // n, 0
            # ended: no jump, and the last entry read was beyond the bound or the last of all
            live = live[better | (within[:, -1] & (place[live] < self.blocks))]
        return current, best


def floors(vec: Column, scale: int = SCALE) -> Column:
    """The components as integers, floor(scale * x), cut at ``LIMIT``."""
    most = F.least(F.lit(float(LIMIT)), F.floor(F.sqrt(F.lit(2.0 ** 53) / F.size(vec))).cast("double"))
    return F.transform(vec, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, -most), most)).cast("long"))


def _integers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """(rows, components) of vectors of equal length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v): kept rows with integer components, filled to a multiple of ``parts``."""
    v = F.col(vec_col)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    filled = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.pmod(-F.size("v"), F.lit(parts)).cast("int")))
    return (vectors.where(F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), floors(v, scale).alias("v"), F.size(v).alias("size"))
            .withColumn("v", filled))


def _seeds(rows: DataFrame, entries: int) -> tuple[np.ndarray, int]:
    """The vectors of the ``entries`` smallest ids, and the length the table is held to."""
    named = (rows.where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("v", "size")).alias("x")).orderBy("vec_id").limit(1).select("x.*").collect()
             or rows.select("v", "size").orderBy("v").limit(1).collect())
    if not named:
        return np.zeros((0, 0), np.int64), 0
    size = named[0]["size"]
    own = rows.where(F.col("size") == size)
    found = (own.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").limit(entries).select("v").collect() or [named[0]])
    return np.array([r["v"] for r in found], dtype=np.int64), size


def _books(seeds: np.ndarray, parts: int) -> list[np.ndarray]:
    return list(np.split(seeds, parts, axis=1))


def _sums(books: list[np.ndarray]) -> Callable:
    """Rows -> (part, entry, n, s): sums of the parts that were coded by each entry."""
    def run(batches):
        search = [Orchard(b) for b in books]
        n = np.zeros((len(books), len(books[0])), np.int64)
        s = [np.zeros_like(b) for b in books]
        for batch in batches:
            x = _integers(batch.column("v"))
            for p, part in enumerate(np.split(x, len(books), axis=1) if len(x) else []):
                code, _ = search[p].nearest(part)
                n[p] += np.bincount(code, minlength=n.shape[1])
                np.add.at(s[p], code, part)
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]),
             pa.array([s[p][e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])
    return run


def train(rows: DataFrame, seeds: np.ndarray, parts: int = PARTS, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds over all rows (v: integer components)."""
    books = _books(seeds, parts)
    width = books[0].shape[1]
    for _ in range(rounds):
        # decimals: no sum overflows, however many rows there are
        total = (rows.select("v").mapInArrow(_sums(books), "part int, entry int, n long, s array<long>").groupBy("part", "entry")
                 .agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", F.lit(i)).cast("decimal(20,0)")) for i in range(width))).alias("s")))
        books = [b.copy() for b in books]
        for r in total.collect():           # parts x entries rows at most
            books[r["part"]][r["entry"]] = [int(c) // r["n"] for c in r["s"]]
    return books


def _coder(books: list[np.ndarray]) -> Callable:
    def run(batches):
        search = [Orchard(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _integers(batch.column("v"))
            found = [o.nearest(part) for o, part in zip(search, np.split(x, len(books), axis=1), strict=True)]
            code = np.stack([c for c, _ in found], axis=1).astype(np.uint8)
            error = np.sum([d for _, d in found], axis=0)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())],
                                             names=["vec_id", "label", "code", "error"])
    return run


def book_digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in decimals by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(c) for b in books for e in b.tolist() for c in e).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error) of every kept row, and the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code byte numbers 1 to 256 entries")
    ship(vectors.sparkSession)
    rows = written(_usable(vectors, id_col, vec_col, label_col, parts, scale))
    seeds, size = _seeds(rows, entries)
    label = rows.schema["label"].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not len(seeds):
        return rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0), []
    rows = rows.where(F.col("size") == size).select("vec_id", "label", "v")
    books = train(rows, seeds, parts, rounds)
    return rows.mapInArrow(_coder(books), schema), books


def decoded(code: Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector a code stands for: its entries, as components of the original scale."""
    flat = [F.array(*(F.array(*(F.lit((int(c) + 0.5) / scale) for c in e)) for e in b)) for b in books]
    number = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")
    return F.concat(*(F.get(b, number(p)) for p, b in enumerate(flat)))


def codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per kept row: vec_id, code, error, label_error (errors summed over equal
    labels) and codebooks_sha256."""
    found, books = compress(vectors, id_col, vec_col, label_col)
    found = written(found)
    per_label = found.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    return found.join(per_label, found["label"].eqNullSafe(per_label["l"])).select(
        "vec_id", "code", "error", "label_error", F.lit(book_digest(books)).alias("codebooks_sha256"))
