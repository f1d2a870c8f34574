"""The pipeline's stages against brute force, and its registration."""

import collections
import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from binsight.llm import additive_quality, language_codes  # noqa: E402

from test_classifiers import language_rows  # noqa: E402
from test_dedup import brute_documents  # noqa: E402
from test_search import words  # noqa: E402

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(vocabulary, seed=3):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([4, 15, 30])))) for i in range(6)]
    rows, n = [], 0
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([30, 80, 150]))]
        for _ in range(rng.choice([1, 1, 1, 3])):
            own = list(base)
            if rng.random() < .5:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            text = " ".join(own)
            if g % 9 == 1:
                text += " " + rng.choice(items)[1]
            if g % 10 == 2:
                text = " ".join(w.upper() + "!!" for w in own)
            rows.append((n, text, "xx", None, len(text)))
            n += 1
    rows += [(n, None, "xx", "s", 0), (n + 1, "", None, "s", 0), (n + 2, "123 ... !!", "xx", None, 1), (None, rows[0][1], None, None, None), (3, rows[3][1], "xx", None, 1)]
    labels = [(r[0], 0 if "!!" in (r[1] or "") else 1, 0) for r in rows[:n]]
    return rows, labels, items


@pytest.fixture(scope="module")
def data(spark, vocabulary, tmp_path_factory):
    rows, labels, items = corpus(vocabulary)
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def ids(df):
    return collections.Counter(r.doc_id for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "packing"]
    assert cp.ORACLE_SQL is None


def test_each_stage_equals_brute_force(spark, data):
    folder, rows, items = data
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns

    out = cp.language_id(spark, docs, folder)
    assert out.columns == columns
    assert ids(out) == collections.Counter(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))
    docs = out.cache()

    out = cp.quality(spark, docs, folder)
    assert out.columns == columns
    kept = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert ids(out) == collections.Counter(r[0] for r in kept if "!!" not in r[1])
    kept = [r for r in kept if "!!" not in r[1]]
    docs = out.cache()

    out = cp.near_dedup(spark, docs, folder)
    assert out.columns == columns
    groups = brute_documents([(r[0], r[1]) for r in kept if r[0] is not None])
    want = {i for i, (_, c) in groups.items() if i == c}
    assert ids(out) == collections.Counter([*want, None])              # a null id is a document of its own, a repeated row stays once
    kept = [r for r in kept if r[0] in want or r[0] is None]
    docs = out.cache()

    out = cp.decontaminate(spark, docs, folder)
    assert out.columns == columns
    windows = set()
    for _, t in items:
        w = words(t)
        windows |= {tuple(w[i:i + min(10, len(w))]) for i in range(len(w) - min(10, len(w)) + 1)}
    hit = lambda t: any(tuple(words(t)[i:i + len(x)]) == x for x in windows for i in range(len(words(t))))
    clean = {r[0] for r in kept if not hit(r[1])}
    assert set(ids(out)) == clean and len(clean) < len({r[0] for r in kept})
    docs = out.cache()

    pieces = cp.packing(spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == clean


def test_texts_under_one_id_are_documents_of_their_own(spark, vocabulary):
    rng = random.Random(21)
    a, b, c = (" ".join(rng.choice(vocabulary) for _ in range(40)) for _ in range(3))
    rows = [(3, a), (7, a), (7, b), (7, b), (9, b), (9, c), (None, a), (None, a), (11, None), (11, "")]
    docs = spark.createDataFrame([(i, t, "xx", None, len(t or "")) for i, t in rows], COLUMNS)
    got = collections.Counter((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())
    assert got == collections.Counter([(3, a), (7, b), (9, c), (None, a), (None, a), (11, None)])          # a null text is an empty one


def test_rows_of_repeated_ids_equal_brute_force(spark, vocabulary):
    """Ids at random: groups are those of the rows, one row of the smallest id stays in each."""
    rng = random.Random(33)
    rows, base = [], []
    for g in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 30, 60]))]
        for _ in range(rng.choice([1, 2, 5])):
            own = list(base)
            if rng.random() < .4:
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((rng.randrange(40), " ".join(own)))
    rows += [(5, ""), (5, None), (5, " "), (6, ""), (6, ""), *rows[:7]]
    groups = brute_documents([(n, t) for n, (_, t) in enumerate(rows)])
    members = collections.defaultdict(list)
    for n, (size, c) in groups.items():
        members[c if size else (rows[n][0], rows[n][1] or "")].append(n)
    docs = spark.createDataFrame([(i, t, "xx", None, None) for i, t in rows], COLUMNS)
    got = collections.Counter((r.doc_id, r.text) for r in cp.near_dedup(spark, docs, "").collect())
    left = collections.Counter(got)
    for own in members.values():
        least = min(rows[n][0] for n in own)
        kept = {rows[n] for n in own if rows[n][0] == least} & set(left)
        assert len(kept) == 1, own
        left -= collections.Counter(kept)
    assert not left


def test_run_applies_all_stages(spark, data):
    folder = data[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
    order = lambda df: sorted(map(repr, df.drop("sequence_id", "offset", "start", "length", "ids_crc32").distinct().collect()))
    assert order(cp.run(spark, folder)) == order(docs)


def test_stages_of_an_empty_table(spark, data):
    folder = data[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0, name


def test_clashing_and_further_columns_survive(spark, data):
    folder = data[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "'a' as score", "1 as kept", "'k' as k1", "2 as lang_pred", "3 as body")
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and {r.score for r in out.select("score").distinct().collect()} == {"a"}, name


def test_registered_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(entry.oracle_sql()) <= names


def test_the_models_decide_the_first_two_stages(spark, vocabulary):
    """Mixed texts go where op5 flags them, and what op10 predicts as 0 goes:
    neither stage equals a test for letters or another threshold."""
    rows = language_rows(2, per=80)
    a, b = ([w for _, t, x in rows if x == l for w in t.split()][:1000] for l in ("l00", "l01"))
    for share in range(0, 1000, 2):
        rows.append((len(rows), " ".join(a[:share] + b[:1000 - share]), None))
    docs = spark.createDataFrame([(i, t, x, None, len(t)) for i, t, x in rows], COLUMNS)
    own = {r.doc_id: r for r in language_codes.identify(docs).collect()}
    want = {i for i, r in own.items() if r.lang_pred != "und" and not r.ambiguous}
    assert set(ids(cp.language_id(spark, docs, ""))) == want and 0 < len(own) - len(want) < 150
    assert {i for i, _, x in rows if x} <= want


def test_quality_stage_takes_the_operators_prediction(spark, data):
    folder = data[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id is not null").dropDuplicates(["doc_id"])
    own = additive_quality.score(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    assert set(ids(cp.quality(spark, docs, folder))) == {r.doc_id for r in own.where("predicted = 1").collect()}
    assert {r.predicted == (r.score >= additive_quality.THRESHOLD) for r in own.collect()} == {True}
