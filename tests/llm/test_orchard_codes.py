import math
import random

import numpy as np
import pytest

from binsight.llm import orchard_codes as oc


def brute(rows, parts=4, entries=256, rounds=4):
    """Full comparisons with Python integers; rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2])
    if not kept:
        return [], []
    size = len(named[0][1]) if named else None
    kept = [r for r in kept if len(r[1]) == size]
    first = {}
    for i, v, _ in named:
        if len(v) == size:
            first.setdefault(i, v)
    cut = lambda v: [v[p * size // parts:(p + 1) * size // parts] for p in range(parts)]
    books = [[cut(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, v, _ in kept:
                own.setdefault(nearest(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    out, total = [], {}
    for i, v, lab in kept:
        found = [nearest(cut(v)[p], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), lab))
        total[lab] = total.get(lab, 0) + out[-1][2]
    return [(i, c, e, total[lab]) for i, c, e, lab in out], books


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)


def check(spark, rows, kind="float"):
    got = oc.codes(frame(spark, rows, kind)).collect()
    want, books = brute(rows)
    assert sorted((repr(r[:4]) for r in map(tuple, got))) == sorted(map(repr, want))
    assert {r.codebooks_sha256 for r in got} == {oc.book_digest([np.array(b) for b in books])}
    return got


@pytest.mark.parametrize("size", [3, 50, 1000, oc.LIMIT])
def test_search_is_exact(size):
    rng = np.random.default_rng(size)
    for _ in range(8):
        entries, queries = rng.integers(-size, size, (int(rng.integers(1, 257)), int(rng.integers(1, 17)))), None
        queries = rng.integers(-size, size, (200, entries.shape[1]))
        code, far = oc.Orchard(entries).nearest(queries)
        d = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=-1)
        assert (code == d.argmin(axis=1)).all() and (far == d.min(axis=1)).all()


def test_search_skips_what_is_too_far():
    rng = np.random.default_rng(1)
    entries = rng.integers(-10_000, 10_000, (256, 3))
    queries = entries[rng.integers(0, 256, 500)] + rng.integers(-50, 50, (500, 3))
    search = oc.Orchard(entries)
    search.nearest(queries)
    assert search.read / 500 < 90                     # of 256 entries


def vectors(n, dims=8, seed=1):
    rng = random.Random(seed)
    return [(i, [float(np.float32(rng.gauss(0, 0.3))) for _ in range(dims)], rng.choice([1, 1, 1, 2, None])) for i in range(n)]


def test_against_brute_force(spark):
    rows = vectors(700)
    random.Random(2).shuffle(rows)
    got = check(spark, rows)
    assert len(got) == 700 and len({r.code for r in got}) > 256


def test_copies_ties_and_few_rows(spark):
    same = [0.25] * 8
    check(spark, [(i, same, 1) for i in range(30)])
    check(spark, [(9, same, None)])
    rows = vectors(20, seed=3)
    check(spark, rows + [(100 + i, v, lab) for i, v, lab in rows])


def test_edges(spark):
    bad = [(1, None, 1), (2, [0.1, None] * 4, 1), (3, [float("nan")] + [0.0] * 7, 1), (4, [float("inf")] * 8, 1), (5, [], 1)]
    rows = [(i + 10, v, lab) for i, v, lab in vectors(40, seed=5)]
    got = check(spark, bad + rows + [(None, rows[0][1], 1), rows[0], (400, [0.0] * 8, 7), (401, [0.5] * 4, 7)], kind="double")
    assert len(got) == 43                               # the shorter vector and the bad ones are dropped
    assert oc.codes(frame(spark, bad)).collect() == [] and oc.codes(frame(spark, [])).collect() == []
    odd = oc.codes(frame(spark, [(i, v[:6], lab) for i, v, lab in rows])).collect()
    assert len(odd) == 40 and len({r.code for r in odd}) > 1          # 6 components: filled with zeros
    huge = oc.codes(frame(spark, [(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [0.0] * 8, 2)])).collect()
    assert [r.error for r in huge] == [0, 0, 0]
    extra = frame(spark, rows).selectExpr("*", "'x' as code", "1 as error", "2 as v", "3 as size")
    assert sorted(map(tuple, oc.codes(extra).collect())) == sorted(map(tuple, oc.codes(frame(spark, rows)).collect()))


def test_codes_stand_for_vectors(spark):
    rows = vectors(300, seed=8)
    found, books = oc.compress(frame(spark, rows))
    back = found.withColumn("v", oc.decoded(found["code"], books))
    by_id = {i: v for i, v, _ in rows}
    for r in back.collect():
        away = sum((1024 * a - 1024 * b) ** 2 for a, b in zip(by_id[r.vec_id], r.v, strict=True))
        assert abs(away - r.error) <= 2 * 8 * (1 + math.sqrt(r.error))          # within rounding to integers
