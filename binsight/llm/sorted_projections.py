"""Near-duplicate vectors by sorted projection passes.

Every pass draws its own random hyperplanes, orders the vectors of a label
lexicographically by the concatenated sign bits, and compares each vector with
its next ``window`` neighbours by cosine in double precision.  A task unites the
verified pairs of its range and passes on one link per vector; the links of all
passes give the components.

The vectors of a label that share a pass's leading ``bits`` are a cell, and all
pairs of a cell are compared.  The windows do so for cells of up to ``window``
+ 1 vectors inside one range.  Larger cells, and those that a border of two
ranges cuts, are finished if their members share a component by then; in the
others, the members outside the cell's largest component are held against all
members of other components, in blocks of bounded size.

Direct links are then counted, not listed.  All vectors within half the
threshold's angle of their component's mean direction are linked with one
another for certain (triangle inequality on the sphere), so for them the count
is the size of that ball; only vectors outside it are compared with the members of
their component, in blocks of bounded size that return counts.  A large group of
copies so costs a sum.

Neighbours at the threshold agree on one bit with ``1 - angle / pi``, so they
share a cell with that to the power of ``bits``; the number of passes holds the
chance that they share none at ``miss``, however the vectors are spread.  More
bits mean smaller cells and more passes: the sizes of the cells of one pass,
counted over all rows, give the number of bits that costs least.

Defined results: vectors that are null, empty, all zero or hold null or
non-finite components, and vectors with a null label or id, link with nothing
(component is the own id, kept true).  Rows that share an id are one vector: a
link of any of them counts once.  Vectors of unequal length never link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import connected_components, cut, fresh, ship

BITS = 62
_BLOCK = 256
_CELL_ROWS = 1024          # of a cell, held against each other at a time
#: numbers of leading bits that are weighed against each other
_LEVELS = [*range(1, 11), *range(12, 25, 2), *range(28, 49, 4)]
#: cost of moving a row once, in comparisons of two vectors
_MOVE = 1500


def passes_for(bits: int, threshold: float, miss: float) -> int:
    together = (1 - math.acos(threshold) / math.pi) ** bits
    return max(4, math.ceil(math.log(miss) / math.log1p(-together)))


def bits_for(rows: DataFrame, window: int, threshold: float, miss: float) -> int:
    """Leading bits of least cost by the cell sizes of the first pass; copies, which
    no bits part and the windows link, count once."""
    keys = rows.mapInArrow(_keys(1, False), "pass int, grp long, key long, vec_id long").select("grp", "key").distinct()
    size = (keys.select("grp", "key", F.explode(F.array(*map(F.lit, _LEVELS))).alias("bits"))
            .groupBy("grp", "bits", F.expr(f"shiftright(key, {BITS} - bits)").alias("cell")).agg(F.count("*").cast("double").alias("n")))
    over = F.when(F.col("n") > window + 1, F.col("n")).otherwise(0.0)
    cost = {r.bits: passes_for(r.bits, threshold, miss) * r.cost for r in size.groupBy("bits").agg(
        F.sum(_MOVE * F.col("n") + over * (_MOVE + 2 * F.col("n"))).alias("cost")).collect()}
    return min(cost, key=lambda bits: (cost[bits], bits), default=_LEVELS[0])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _stack(column: pa.Array) -> np.ndarray:
    """Equal-length vectors given as bytes of doubles or floats."""
    values = column.to_pylist()
    kind = np.dtype("<f4") if values[0][:1] == b"f" else np.dtype("<f8")
    return np.stack([np.frombuffer(v, dtype=kind, offset=8) for v in values]).astype(np.float64)


def _packed(column: pa.Array) -> list[bytes]:
    """Vectors as bytes; the first of 8 leading bytes names the precision."""
    single = column.type.value_type == pa.float32()
    head = (b"f" if single else b"d") + b"\0" * 7
    kind = np.float32 if single else np.float64
    return [head + np.asarray(v.values.to_numpy(zero_copy_only=False), dtype=kind).tobytes() for v in column]


def _by_size(column: pa.Array) -> dict[int, np.ndarray]:
    size = np.array([len(v) for v in column.to_pylist()])
    return {int(s): np.flatnonzero(size == s) for s in np.unique(size)}


def _usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, grp, v): rows that can link; grp stands for the label and the length."""
    v = F.col(vec_col)
    fine = (F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull()
            & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0))

    def packed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("grp"), pa.array(_packed(b.column("v")), pa.binary())], names=["vec_id", "grp", "v"])

    kind = vectors.schema[vec_col].dataType.elementType.typeName()
    v = v if kind in ("float", "double") else v.cast("array<double>")
    return (vectors.where(F.coalesce(fine, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.xxhash64(F.col(label_col), F.size(vec_col)).alias("grp"), v.alias("v"))
            .mapInArrow(packed, "vec_id long, grp long, v binary"))


def _keys(passes: int, vectors: bool = True):
    """Rows once per pass, with the pass's concatenated hash bits."""
    def run(batches):
        planes: dict[tuple[int, int], np.ndarray] = {}
        weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            for s, own in _by_size(b.column("v")).items():
                take = pa.array(own)
                vid, grp, v = (b.column(c).take(take) for c in ("vec_id", "grp", "v"))
                x = unit(_stack(v))
                for p in range(passes):
                    if (p, x.shape[1]) not in planes:
                        planes[p, x.shape[1]] = np.random.default_rng([p, 11]).standard_normal((x.shape[1], BITS))
                    key = ((x @ planes[p, x.shape[1]]) > 0).astype(np.int64) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), p, np.int32)), grp, pa.array(key), vid, *([v] if vectors else [])],
                                                     names=["pass", "grp", "key", "vec_id", *(["v"] if vectors else [])])
    return run


class _Forest(dict):
    def root(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = x = self.get(up, up)
        return x

    def unite(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self[max(a, b)] = min(a, b)
            self.setdefault(min(a, b), min(a, b))


def _neighbours(window: int, threshold: float, bits: int):
    """Sorted rows -> (pass, a, b, large): each linked vector with the root of its
    local group (pass -1), and as (pass, grp, cell) the cells that the windows may
    not have compared whole: large ones, the first and the last of the range."""
    def run(batches):
        forest, where = _Forest(), None
        first, cell, n, cells = None, None, 0, []
        ids, x = np.zeros(0, np.int64), None           # rows whose windows are still open

        def compare(ids, x, upto):
            for i in range(0, upto, _BLOCK):
                j = min(i + _BLOCK, upto)
                near = x[i:j] @ x[i:j + window].T >= threshold
                a, b = np.nonzero(near)
                ok = (b > a) & (b - a <= window)
                for p, q in zip(ids[i + a[ok]].tolist(), ids[i + b[ok]].tolist(), strict=True):
                    if p != q:
                        forest.unite(p, q)

        def found():
            rows = [(-1, k, r, False) for k in forest if (r := forest.root(k)) != k] + cells
            forest.clear()
            cells.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.bool_()))],
                                              names=["pass", "a", "b", "large"])

        for batch in batches:
            if not batch.num_rows:
                continue
            run_of, grp = batch.column("pass").to_numpy(), batch.column("grp").to_numpy()
            lead = batch.column("key").to_numpy() >> (BITS - bits)
            edge = np.flatnonzero((np.diff(run_of) != 0) | (np.diff(grp) != 0)) + 1
            for s, e in zip([0, *edge], [*edge, batch.num_rows], strict=True):
                s, e = int(s), int(e)
                here = (int(run_of[s]), int(grp[s]))
                if here != where:
                    if len(ids):
                        compare(ids, x, len(ids))
                    if where is not None and here[0] != where[0] and (forest or cells):
                        yield found()
                    ids, x, where = np.zeros(0, np.int64), None, here
                turn = np.flatnonzero(np.diff(lead[s:e])) + 1 + s
                for i, j in zip([s, *turn.tolist()], [*turn.tolist(), e], strict=True):
                    if (*here, int(lead[i])) != cell:
                        if cell is not None and (n > window + 1 or cell == first):
                            cells.append((*cell, n > window + 1))
                        cell, n = (*here, int(lead[i])), 0
                        first = first or cell
                    n += j - i
                own = unit(_stack(batch.column("v").slice(s, e - s)))
                ids = np.concatenate([ids, batch.column("vec_id").slice(s, e - s).to_numpy()])
                x = own if x is None else np.concatenate([x, own])
                done = max(0, len(ids) - window)
                compare(ids, x, done)
                ids, x = ids[done:], x[done:]
        if len(ids):
            compare(ids, x, len(ids))
        if cell is not None:
            cells.append((*cell, n > window + 1))
        yield found()
    return run


def _across(threshold: float):
    """Links of a block's outside members with the members of the cell's largest
    component (``j`` >= 0) or with outside members, as links of their components."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        group, outside = block.column("g").to_numpy(), block.column("outside").to_numpy(zero_copy_only=False)
        x, j = unit(_stack(block.column("v"))), block.column("j")[0].as_py()
        left = np.flatnonzero(outside)
        right = left if j < 0 else np.flatnonzero(~outside)
        forest = _Forest()
        for s in range(0, len(left), _BLOCK):
            own = left[s:s + _BLOCK]
            a, b = np.nonzero(x[own] @ x[right].T >= threshold)
            for p, q in set(zip(group[own[a]].tolist(), group[right[b]].tolist(), strict=True)):
                forest.unite(p, q)
        rows = [(k, r) for k in forest if (r := forest.root(k)) != k]
        return pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())})
    return run


def _upto(n: str):
    return F.sequence(F.lit(0).cast("long"), F.col(n) - 1)


def _cell_links(rows: DataFrame, cells: DataFrame, groups: DataFrame, passes: int, bits: int, threshold: float) -> DataFrame:
    """(a, b): links between the components ``groups`` by the pairs of ``cells``."""
    cell = ["pass", "grp", "cell"]
    named = (rows.mapInArrow(_keys(passes, False), "pass int, grp long, key long, vec_id long")
             .select("pass", "grp", F.shiftright("key", BITS - bits).alias("cell"), "vec_id").join(cells, cell).distinct()
             .join(groups.withColumnRenamed("id", "vec_id"), "vec_id", "left")
             .select(*cell, "vec_id", F.coalesce("component", "vec_id").alias("g")))
    named = cut(named)
    blocks = lambda n: F.ceil(n / _CELL_ROWS).cast("long")
    split = (named.groupBy(*cell, "g").agg(F.count("*").alias("c")).groupBy(*cell)
             .agg(F.count("*").alias("parts"), F.max(F.struct("c", "g")).alias("top"), F.sum("c").alias("c")).where("parts > 1")
             .select(*(fresh(c) for c in cell), F.col("top.g").alias("top"), blocks(F.col("c") - F.col("top.c")).alias("out"), blocks(F.col("top.c")).alias("in")))
    # block (i, j): part i of the outside members with part j of the largest
    # component, or with part -1 - j of the outside members
    parts = (named.join(split, cell).withColumn("outside", F.col("g") != F.col("top"))
             .withColumn("own", F.pmod(F.xxhash64("vec_id", *cell), F.when(F.col("outside"), F.col("out")).otherwise(F.col("in"))))
             .withColumn("block", F.explode(F.when(F.col("outside"), F.concat(
                 F.transform(_upto("in"), lambda j: F.struct(F.col("own").alias("i"), j.alias("j"))),
                 F.transform(_upto("out"), lambda v: F.struct(F.least("own", v).alias("i"), (-1 - F.greatest("own", v)).alias("j")))))
                 .otherwise(F.transform(_upto("out"), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"))))))
             .select(*cell, "block.i", "block.j", "vec_id", "outside", "g"))
    return (parts.join(rows, ["vec_id", "grp"]).groupBy(*cell, "i", "j").applyInArrow(_across(threshold), "a long, b long").distinct())


def components(rows: DataFrame, passes: int, bits: int, window: int, threshold: float) -> DataFrame:
    """(id, component) of the linked vectors."""
    keyed = rows.mapInArrow(_keys(passes), "pass int, grp long, key long, vec_id long, v binary")
    order = ["pass", "grp", "key", "vec_id"]
    found = cut(keyed.repartitionByRange(*order).sortWithinPartitions(*order)
                .mapInArrow(_neighbours(window, threshold, bits), "pass int, a long, b long, large boolean")
                .groupBy("pass", "a", "b").agg(F.max("large").alias("large"), F.count("*").alias("ranges")))
    groups = cut(connected_components(found.where("pass < 0").select("a", "b")))
    cells = found.where("pass >= 0 and (large or ranges > 1)").select("pass", F.col("a").alias("grp"), F.col("b").alias("cell"))
    merged = cut(connected_components(_cell_links(rows, cells, groups, passes, bits, threshold)))
    return (groups.select("id", F.col("component").alias("g")).join(merged.select(F.col("id").alias("g"), "component"), "g", "left")
            .select("id", F.coalesce("component", "g").alias("component"))
            .unionByName(merged).groupBy("id").agg(F.min("component").alias("component")))


def _sums(batches):
    """Partial sums of unit vectors by component."""
    for b in batches:
        if not b.num_rows:
            continue
        comp = b.column("component").to_numpy()
        for own in _by_size(b.column("v")).values():
            x = unit(_stack(b.column("v").take(pa.array(own))))
            names, at = np.unique(comp[own], return_inverse=True)
            total = np.zeros((len(names), x.shape[1]))
            np.add.at(total, at, x)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([t.tobytes() for t in total], pa.binary())], names=["component", "s"])


def _total(group: pa.Table) -> pa.Table:
    s = np.sum([np.frombuffer(v, dtype=np.float64) for v in group.column("s").to_pylist()], axis=0)
    n = np.sqrt((s * s).sum())
    return pa.table({"component": group.column("component").slice(0, 1), "centre": pa.array([(s / n if n > 0 else s).tobytes()], pa.binary())})


def _inside(cosine: float):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            near = np.zeros(b.num_rows, dtype=bool)
            for own in _by_size(b.column("v")).values():
                take = pa.array(own)
                c = np.stack([np.frombuffer(v, dtype=np.float64) for v in b.column("centre").take(take).to_pylist()])
                near[own] = (unit(_stack(b.column("v").take(take))) * c).sum(axis=1) >= cosine
            yield pa.RecordBatch.from_arrays([b.column("component"), b.column("vec_id"), b.column("v"), pa.array(near)], names=["component", "vec_id", "v", "inside"])
    return run


def _counts(threshold: float):
    """Links of one block of vectors outside their component's ball with one block of all
    its vectors, counted at the outer end and, where it lies inside, at the other."""
    def run(block: pa.Table) -> pa.Table:
        block = block.combine_chunks()
        names, at = np.unique(block.column("vec_id").to_numpy(), return_inverse=True)
        side, inside = block.column("outer").to_numpy(zero_copy_only=False), block.column("inside").to_numpy(zero_copy_only=False)
        x = unit(_stack(block.column("v")))
        outer, all_ = np.flatnonzero(side), np.flatnonzero(~side)
        found = [np.zeros(0, dtype=np.int64)]
        for s in range(0, len(outer), _BLOCK):
            a, b = np.nonzero(x[outer[s:s + _BLOCK]] @ x[all_].T >= threshold)
            a, b = outer[s:s + _BLOCK][a], all_[b]
            found.append(((at[a] * len(names) + at[b]) * 2 + inside[b])[at[a] != at[b]])
        pair, within = np.divmod(np.unique(np.concatenate(found)), 2)         # repeated rows count once
        a, b = np.divmod(pair, max(len(names), 1))
        c = np.bincount(np.concatenate([a, b[within == 1]]), minlength=len(names))
        keep = np.flatnonzero(c)
        return pa.table({"vec_id": pa.array(names[keep], pa.int64()), "c": pa.array(c[keep], pa.int64())})
    return run


def _outer_links(members: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, c): links with at least one end outside a ball, counted in blocks of
    about ``_CELL_ROWS`` vectors; an id's rows share a block."""
    blocks = lambda n: F.ceil(n / _CELL_ROWS).cast("long")
    sizes = (members.groupBy("component").agg(F.count_if(~F.col("inside")).alias("o"), F.count("*").alias("n")).where("o > 0")
             .select(fresh("component"), blocks(F.col("o")).alias("out"), blocks(F.col("n")).alias("whole")))
    i, j = (F.pmod(F.xxhash64("vec_id"), F.col(n)) for n in ("out", "whole"))
    as_any = F.transform(_upto("out"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("outer")))
    as_outer = F.transform(_upto("whole"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("outer")))
    cells = (members.join(sizes, "component")
             .withColumn("cell", F.explode(F.when(F.col("inside"), as_any).otherwise(F.concat(as_any, as_outer))))
             .select("component", "cell.i", "cell.j", "cell.outer", "vec_id", "v", "inside"))
    return cells.groupBy("component", "i", "j").applyInArrow(_counts(threshold), "vec_id long, c long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
                    threshold: float = 0.93, window: int = 64, miss: float = 1e-4, passes: int | None = None) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept."""
    ship(vectors.sparkSession)
    rows = _usable(vectors, id_col, vec_col, label_col)
    bits = bits_for(rows, window, threshold, miss)
    passes = passes or passes_for(bits, threshold, miss)
    groups = cut(components(rows, passes, bits, window, threshold))
    members = cut(rows.join(groups.withColumnRenamed("id", "vec_id"), "vec_id").select("component", "vec_id", "v"))
    centres = members.mapInArrow(_sums, "component long, s binary").groupBy("component").applyInArrow(_total, "component long, centre binary")
    # half the angle, tightened by far more than rounding errors
    half = math.cos(math.acos(threshold) / 2) + 1e-9
    members = cut(members.join(cut(centres), "component").select("component", "vec_id", "v", "centre")
                  .mapInArrow(_inside(half), "component long, vec_id long, v binary, inside boolean"))
    ball = cut(members.where("inside").groupBy("component").agg(F.countDistinct("vec_id").alias("size")))
    in_ball = members.where("inside").select("vec_id", "component").distinct().join(ball, "component").select("vec_id", (F.col("size") - 1).alias("c"))
    counts = _outer_links(members, threshold).unionByName(in_ball).groupBy("vec_id").agg(F.sum("c").alias("c"))
    per_id = groups.withColumnRenamed("id", "vec_id").join(counts, "vec_id", "left")
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"))
    return own.join(per_id, "vec_id", "left").select(
        "vec_id", F.coalesce("c", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component", "vec_id"), F.lit(True)).alias("kept"))
