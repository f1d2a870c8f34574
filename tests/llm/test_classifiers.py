import math
import random
import zlib

import numpy as np
import pytest

from binsight.llm import additive_quality as aq
from binsight.llm import language_codes as lc


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def language_rows(n_languages, per=60, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n_languages):
        sounds = ["".join(rng.choice("aeioubcdfglmnprst") for _ in range(3)) for _ in range(25)]
        rows += [(len(rows) + j, " ".join("".join(rng.choice(sounds) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(15, 80))), f"l{k:02d}") for j in range(per)]
    return rows


@pytest.mark.parametrize("n", [1, 2, 4, 7, 12])
def test_codewords_are_apart(n):
    code = lc.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
    for a in range(n):
        for b in range(a):
            assert (code[a] != code[b]).sum() >= (1 if n < 3 else 2 if n < 4 else code.shape[1] // 4)
    assert all(0 < (code[:, j] > 0).sum() < n for j in range(code.shape[1])) or n == 1


@pytest.mark.parametrize("n", [4, 9])
def test_languages_of_held_out_rows(spark, n):
    rows = language_rows(n)
    got = {r.doc_id: r for r in lc.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=40).collect()}
    out = [(got[i].lang_pred == lang) for i, _, lang in rows if held(i)]
    assert np.mean(out) > 0.97 and all(got[i].held_out == held(i) for i, *_ in rows)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_the_held_out_part_teaches_nothing(spark):
    rows = language_rows(3)
    turned = [(i, t, "wrong" if held(i) else lang) for i, t, lang in rows]
    a, b = (lc.train(spark.createDataFrame(x, "doc_id long, text string, lang string")) for x in (rows, turned))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_a_mixture_is_ambiguous():
    x = np.eye(2)[[0] * 50 + [1] * 50] + np.random.default_rng(0).normal(0, .01, (100, 2))
    model = lc.fit(x, ["a"] * 50 + ["b"] * 50)
    t = np.linspace(0, 1, 2001)
    best, share, vague = lc.decode(model, np.column_stack([1 - t, t]))
    turn = int(np.flatnonzero(np.diff(best))[0])               # where the nearest codeword changes
    assert (best[0], best[-1]) == (0, 1) and not vague[0] and not vague[-1]
    assert vague[turn] and vague.sum() < 400 and share[turn] < 0.6 < share[0]


def plain_decode(model, margins):
    """Nearest codeword and ambiguity of one text by a double loop over codewords and bits."""
    total, losses = sum(model.bit_weight) or 1.0, []
    for row in model.code:
        losses.append(sum(w * math.log1p(math.exp(-b * m)) for b, m, w in zip(row, margins, model.bit_weight)) / total)
    near = sorted(losses)
    return losses.index(near[0]), len(near) > 1 and near[1] - near[0] < model.ambiguous_below


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_decoding_equals_a_double_loop(n):
    rng = np.random.default_rng(n)
    bits = lc.codewords(n).shape[1]
    model = lc.Model([f"l{i}" for i in range(n)], lc.codewords(n), rng.normal(size=(6, bits)), rng.normal(size=bits), rng.uniform(.1, 1, bits), .05)
    x = rng.normal(size=(200, 6))
    best, _, vague = lc.decode(model, x)
    assert [(int(b), bool(v)) for b, v in zip(best, vague)] == [plain_decode(model, m) for m in x @ model.weights + model.bias]


def test_language_edge_rows(spark, edge_docs):
    docs = edge_docs.selectExpr("*", "'xx' as lang")
    got = lc.identify(docs).collect()
    assert len(got) == 13
    for r in got:
        assert (r.lang_pred == "und" and r.score == 0) if r.doc_id in (1, 2, 3) else r.lang_pred in ("xx", "und")
    assert {r.lang_pred for r in lc.identify(edge_docs.selectExpr("*", "cast(null as string) as lang")).collect()} == {"und"}
    assert lc.identify(docs.limit(0)).count() == 0
    digits = spark.createDataFrame([(1, "123 456 !!"), (3, "abc"), (4, "def")], "doc_id long, text string").selectExpr("*", "'xx' as lang")
    assert {r.doc_id: r.lang_pred for r in lc.identify(digits).collect()} == {1: "und", 3: "xx", 4: "xx"}


def quality_rows(vocabulary, n=500):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        own, bad = [rng.choice(vocabulary) for _ in range(rng.randint(5, 120))], i % 4
        if bad == 1:
            own = [w.upper() + "!!" for w in own]
        elif bad == 2:
            own = [w + rng.choice(["$$$", "%%%"]) for w in own]
        elif bad == 3 and i % 8 == 3:
            own = [own[0]] * len(own)
        rows.append((i, " ".join(own)))
        labels.append((i, 0 if bad in (1, 2) or i % 8 == 3 else 1))
    return rows, labels


def test_quality_of_held_out_rows(spark, vocabulary):
    rows, labels = quality_rows(vocabulary)
    got = {r.doc_id: r for r in aq.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    out = [got[i].predicted == y for i, y in labels if held(i)]
    assert np.mean(out) > 0.96 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out == held(i) for i, _ in rows)


def test_pairwise_tables_learn_an_interaction():
    """Exclusive or of two features: no single table helps, one joint table does."""
    rng = np.random.default_rng(2)
    x = np.zeros((4000, len(aq.FEATURES)))
    x[:, 2], x[:, 5] = rng.random(4000), rng.random(4000)
    y = ((x[:, 2] > 0.5) ^ (x[:, 5] > 0.5)).astype(float)
    model = aq.fit(x, y)
    assert (5, 2) in model.pairs and ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert ((aq.fit(x, y, n_pairs=0).scores(x) > 0.5) == y).mean() < 0.7


def test_scores_add_one_bin_of_every_table():
    rng = np.random.default_rng(3)
    x = rng.random((300, len(aq.FEATURES)))
    model = aq.fit(x, (x[:, 0] > 0.4).astype(float), rounds=5)
    b = model.bins(x)
    for row in range(0, 300, 37):
        total = model.base + sum(t[b[row, f]] for f, t in enumerate(model.single)) + sum(t[b[row, f], b[row, g]] for (f, g), t in zip(model.pairs, model.joint, strict=True))
        assert model.scores(x[row:row + 1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_edge_rows(spark, edge_docs):
    labels = spark.createDataFrame([(6, 1), (6, 1), (7, 1), (4, 0), (2, 0), (9, None), (None, 1), (99, 1), (5, 7)], "doc_id long, quality int").selectExpr("*", "1 as h", "2 as id", "3 as toxic")
    for own in (labels, labels.limit(0), labels.where("quality = 1")):
        got = aq.score(edge_docs, own).collect()
        assert len(got) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert aq.score(edge_docs.limit(0), labels).count() == 0


def test_only_letters_make_a_language(spark, vocabulary):
    """Digits in circles, fractions, raised digits and underscores are no letters (category L)."""
    import random

    from binsight.llm import language_codes
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(30)), rng.choice(["en", "fr"])) for i in range(80)]
    rows += [(1000 + i, t, None) for i, t in enumerate(["²", "½ ①", "__ 12 ٣", "Ⅻ", "́", "", None])] + [(2000, "ª", None), (2001, "字", None)]
    got = {r.doc_id: r.lang_pred for r in language_codes.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[1000 + i] for i in range(7)} == {"und"} and "und" not in (got[2000], got[2001])
