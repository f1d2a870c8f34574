import collections
import math
import random

import numpy as np
import pytest

from binsight.llm import minmax_dedup as md
from binsight.llm import sorted_projections as sp
from binsight.llm.common import connected_components


def union(ids, edges):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# ------------------------------------------------------------ components

@pytest.mark.parametrize("seed", [0, 1])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(-50, 150), rng.randrange(-50, 150)) for _ in range(120)]
    edges += [(500, x) for x in range(300, 400)]                                     # a hub that is not the smallest
    edges += [(x, x + 1) for x in range(600, 640)]                                   # a path
    got = connected_components(spark.createDataFrame([*edges, (None, 1), (7, None)], "a long, b long")).collect()
    want = union({x for e in edges for x in e}, edges)
    used = {x for a, b in edges if a != b for x in (a, b)}
    assert {r.id: r.component for r in got} == {i: c for i, c in want.items() if i in used} and len(got) == len(used)


def test_components_of_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------ documents

def shingles(text, k=4):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_documents(rows, percent=80):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    inverted = collections.defaultdict(list)
    for i in ids:
        for s in sets[i]:
            inverted[s].append(i)
    both = collections.Counter((a, b) for own in inverted.values() for n, a in enumerate(own) for b in own[n + 1:])
    edges = [(a, b) for (a, b), c in both.items() if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c)]
    return {i: (len(sets[i]), c) for i, c in union(ids, edges).items()}


def near_copies(vocabulary, seed):
    rng = random.Random(seed)
    rows, n = [], 0
    passage = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 40, 200]))]
        for _ in range(rng.choice([1, 2, 25])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((n, " ".join(own)))
            n += 1
    for _ in range(40):                                     # one passage in many otherwise different documents
        own = [rng.choice(vocabulary) for _ in range(40)]
        rows.append((n, " ".join(own[:20] + passage + own[20:])))
        n += 1
    chain = [rng.choice(vocabulary) for _ in range(90)]     # each like the next, the ends unlike
    for i in range(15):
        rows.append((n, " ".join(chain)))
        chain[i * 6 % 90] = rng.choice(vocabulary)
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_equal_brute_force(spark, vocabulary, seed):
    rows = near_copies(vocabulary, seed)
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_documents(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


def test_links_between_groups_of_a_bucket_are_found(spark, vocabulary):
    """One band of one permutation puts everything similar into few buckets, so the
    pass over what the buckets' ends did not link has to find the rest."""
    rows = near_copies(vocabulary, 5)
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), perms=60, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute_documents(rows).items()}


@pytest.mark.parametrize("size,shingles", [(4, 1 << 20), (1 << 10, 300)])
def test_blocks_of_a_bucket_find_the_same_links(spark, vocabulary, monkeypatch, size, shingles):
    monkeypatch.setattr(md, "_BLOCK_ROWS", size)
    monkeypatch.setattr(md, "_BLOCK_SHINGLES", shingles)
    rows = near_copies(vocabulary, 6)
    got = md.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), perms=60, rows=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {i: c for i, (_, c) in brute_documents(rows).items()}


def test_document_edge_rows(spark, edge_docs):
    got = sorted((tuple(r) for r in md.near_duplicates(edge_docs).collect()), key=repr)
    assert len(got) == 13
    by = collections.defaultdict(set)
    for i, n, c, kept in got:
        by[i].add((n, c, kept))
    assert by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)} and by[3] == {(0, 3, True)}
    assert by[4] == {(1, -3, False)} and by[-3] == {(1, -3, True)}
    assert by[6] == {(57, 6, True)} and by[7] == {(57, 6, False)} and by[9] == {(57, 6, False)}
    assert by[None] == {(57, None, True), (0, None, True)}
    assert by[5].pop()[1:] == (5, True)
    assert md.near_duplicates(edge_docs.limit(0)).count() == 0


def test_min_max_signature_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 62, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 62, 200).astype(np.uint64)])
    x = md.min_max_values(np.concatenate([a, b]), np.array([0, 1000]), 400)
    assert abs((x[0] == x[1]).mean() - 800 / 1200) < 0.05


# ------------------------------------------------------------ vectors

def brute_vectors(rows, threshold=0.93):
    ok = {}
    for i, e, label in rows:
        if i is None or label is None or not e or any(x is None or not math.isfinite(x) for x in e) or not any(e):
            continue
        v = np.array(e, dtype=np.float64)
        ok.setdefault(i, []).append((label, v / np.linalg.norm(v)))
    ids, edges = sorted(ok), []
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if any(p == q and len(x) == len(y) and x @ y >= threshold for p, x in ok[a] for q, y in ok[b]):
                edges.append((a, b))
    every = {i for i, *_ in rows if i is not None}
    comp, deg = union(every, edges), collections.Counter(x for e in edges for x in e)
    return {i: (deg[i], comp[i], comp[i] == i) for i in every}, edges


def vector_rows(seed, n=500, dims=16):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n // 5):
        base = rng.standard_normal(dims)
        for _ in range(int(rng.choice([1, 2, 12]))):
            rows.append((len(rows), (base + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.2, 0.35])).tolist(), int(rng.integers(0, 2))))
    return rows


def test_vectors_equal_brute_force(spark):
    rows = vector_rows(3)
    got = sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("vec_id", "cast(embedding as array<double>) embedding", "label"), window=400)
    rows = [(i, [float(np.float32(x)) for x in e], lab) for i, e, lab in rows]
    want, edges = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()} == want and len(edges) > 100


def test_vector_recall_of_the_production_parameters(spark):
    rows = vector_rows(4, 3000)
    got = {r.vec_id: r for r in sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    want, edges = brute_vectors(rows)
    found = sum(got[a].component_id == got[b].component_id for a, b in edges) / len(edges)
    counted = sum(r.n_links for r in got.values()) / sum(w[0] for w in want.values())
    assert found > 0.99 and 0.99 < counted <= 1


@pytest.mark.parametrize("inner", [0.0, 0.8])
def test_vector_recall_in_a_dense_label(spark, inner):
    """A third of one label lies around one direction; pairs planted among them are
    linked to nothing else, and the windows fill with vectors that link with none."""
    rng = np.random.default_rng(12)

    def turned(x, cosine):
        y = rng.standard_normal(x.shape)
        y -= (y * x).sum(axis=1, keepdims=True) * x
        return cosine * x + math.sqrt(1 - cosine * cosine) * sp.unit(y)

    centre = np.tile(sp.unit(rng.standard_normal((1, 64))), (2000, 1))
    dense = turned(centre, math.sqrt(inner))
    pairs = np.stack([dense[:400], turned(dense[:400], 0.94)], 1).reshape(-1, 64)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([pairs, dense[400:], sp.unit(rng.standard_normal((4000, 64)))]))]
    got = {r.vec_id: r for r in sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[2 * i].component_id == got[2 * i + 1].component_id for i in range(400)) >= 399
    x = np.array([r[1] for r in rows])
    links = (x @ x.T >= 0.93).sum() - len(x)
    assert 0.995 * links <= sum(r.n_links for r in got.values()) <= links


@pytest.mark.parametrize("size", [4, 1024])
def test_cells_over_the_window_and_cut_cells_are_compared_whole(spark, monkeypatch, size):
    """A window of one neighbour: nearly every link comes from the blocks of the cells."""
    monkeypatch.setattr(sp, "_CELL_ROWS", size)
    rows = vector_rows(6, 300)
    got = sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), window=1, miss=1e-9).collect()
    want, _ = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


def test_a_large_group_of_copies_is_counted_without_pairs(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal(24)
    rows = [(i, (base + rng.standard_normal(24) * 0.03).tolist(), 1) for i in range(600)] + [(1000, (base + rng.standard_normal(24) * 0.28).tolist(), 1)]
    got = sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    want, _ = brute_vectors(rows)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want


@pytest.mark.parametrize("n,size", [(500, 64), (3000, 1024)])
def test_an_arc_of_vectors_is_counted_in_blocks(spark, monkeypatch, n, size):
    """One long component, nearly all of it outside the ball: links are those within the angle."""
    monkeypatch.setattr(sp, "_CELL_ROWS", size)
    step = 5.0 / n
    rows = [(i, [math.cos(i * step), math.sin(i * step), 0.0, 0.0], 1) for i in range(n)]
    got = sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    reach = int(math.acos(0.93) / step)
    assert {r.vec_id: r.n_links for r in got} == {i: min(i, reach) + min(n - 1 - i, reach) for i in range(n)}
    assert {r.component_id for r in got} == {0}


def test_vector_edge_rows(spark, clashes):
    e = [1.0, 2.0, 3.0]
    rows = [(1, e, 1), (2, [2.0, 4.0, 6.0], 1), (3, e, None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 3.0], 1), (8, [float("nan"), 2.0, 3.0], 1),
            (9, [float("inf"), 2.0, 3.0], 1), (10, e, 2), (11, [1.0, 2.0], 1), (12, e, 1), (12, e, 1), (None, e, 1), (13, [1e300, 2e300, 3e300], 1), (14, [-1.0, -2.0, -3.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' as grp", "'y' as component", "'z' as inside", "1 as a", "2 as b", "3 as pass")
    got = sp.near_duplicates(df).collect()
    want, _ = brute_vectors([r for r in rows if r[0] != 13] + [(13, e, 1)])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == want | {None: (0, None, True)}
    assert len(got) == len(rows)
    assert sp.near_duplicates(df.limit(0)).count() == 0
