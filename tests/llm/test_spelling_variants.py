import random
import zlib
from collections import Counter

import pytest

from binsight.llm import spelling_variants as sv


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return any(a[i + x:] == b[i + y:] for x, y in ((1, 1), (1, 0), (0, 1)))


def brute(rows, min_length=7, every=31):
    """The contract word by word and pair by pair."""
    n = Counter()
    for doc, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
                continue
            if run:
                h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
                if every and h % every == 0:
                    run = run[:h % len(run)] + run[h % len(run) + 1:]
                if len(run) >= min_length:
                    n[run] += 1
            run = ""
    n = {w: c for w, c in n.items() if c >= 2}
    out = {}
    for w in n:
        others = [x for x in n if near(w, x)]
        best = min(others, key=lambda x: (-n[x], x), default=None)
        out[w] = (best if best and n[best] >= 10 * n[w] else None, len(others))
    rows = set()
    for w, (form, count) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n[w], count, n[form] if form else None))
    return rows


def result(docs, **kw):
    return [tuple(r) for r in sv.variants(docs, **kw).select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize(("letters", "longest"), [("ab", 7), ("ab", 12), ("aab", 20), ("abcde", 8), ("abcdefghijé", 9)])
def test_index_finds_every_near_pair(letters, longest):
    rng = random.Random(len(letters))
    for _ in range(12):
        words = list({"".join(rng.choice(letters) for _ in range(rng.randint(4, longest))) for _ in range(150)})
        words = list({*words, *(w[:i] + w[i + 1:] for w in words[:60] for i in [rng.randrange(len(w))] if len(w) > 4), *(w[:1] + w for w in words[:30])})
        held = Counter(g for w in words for g in {w[i:i + 2] for i in range(len(w) - 1)})
        rank = {g: i for i, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
        index, last, chosen = {}, {}, {}
        for w in words:
            last[w], prefix, chosen[w] = sv.pivots(w, held, rank)
            first, second = chosen[w]
            own = sv._prefix([rank[w[i:i + 2]] for i in range(len(w) - 1)], last[w], 3)
            cost = {(i, j): held[w[i:i + 2]] + held[w[j:j + 2]] for i in own for j in own if j - i >= 2}
            assert set(own) <= set(prefix) and len(prefix) <= 12
            assert cost[first, second] == min(cost.values())          # dynamic programming finds the cheapest disjoint pair
            for key in sv._index_keys(w, prefix):
                index.setdefault(key, set()).add(w)
        for a in words:
            found = {b for key in sv._pivot_keys(a, *chosen[a]) for b in index.get(key, ())}
            assert all(b in found for b in words if near(a, b) and (last[a], a) < (last[b], b))


def test_against_brute_force(spark):
    rng = random.Random(4)
    stems = ["".join(rng.choice("abdéinor") for _ in range(rng.randint(6, 10))) for _ in range(60)]
    rows = []
    for doc in range(150):
        words = [rng.choice(stems[:5] * 30 + stems) for _ in range(120)]
        rows.append((doc, " ".join(w.upper() if rng.random() < 0.1 else w + rng.choice(["", "", "", ",", "×" if rng.random() < 0.1 else "."]) for w in words)))
    got = result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert any(r[1] for r in got) and any(r[4] > 1 for r in got)


def test_forms_are_followed_to_the_root(spark):
    rows = [(1, " ".join(["kalenders"] * 400 + ["kalender"] * 4000 + ["kalendersx"] * 40 + ["xkalendersx"] * 4))]
    got = {r[0]: r for r in result(spark.createDataFrame(rows, "doc_id long, text string"), every=None)}
    assert got["xkalendersx"] == ("xkalendersx", "kalendersx", "kalender", 4, 1, 40)
    assert got["kalender"] == ("kalender", None, "kalender", 4000, 1, None)
    assert set(got.values()) == brute(rows, every=None)


def test_ties_and_many_near_words(spark):
    # both neighbours are equally frequent: the smaller one in code-point order
    rows = [(1, " ".join(["abcdefgh"] * 2 + ["abcdefgé"] * 30 + ["abcdefgz"] * 30 + [f"abcdefg{c}" for c in "bcdefijk"] * 2))]
    got = {r[0]: r for r in result(spark.createDataFrame(rows, "doc_id long, text string"), every=None)}
    assert got["abcdefgh"][1] == "abcdefgz" and got["abcdefgh"][4] == 10
    assert set(got.values()) == brute(rows, every=None)


def test_edges(spark, edge_docs, edge_rows):
    assert set(result(edge_docs)) == brute(edge_rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert result(empty) == [] and sv.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        sv.variants(empty, min_length=3)


def test_long_texts_are_cut_at_word_ends(spark, monkeypatch):
    import re
    text = " ".join(["wonderful"] * 500) + "x" * 5000 + " end"
    monkeypatch.setattr(sv, "_PIECE", 100)
    pieces = list(sv._pieces(text, re.compile(f"[{sv.LETTERS}]*")))
    assert "".join(pieces) == text and max(map(len, pieces)) < 5200
    assert Counter(w for p in pieces for w in p.split()) == Counter(text.split())
    long = "ab" * 100_000
    got = result(spark.createDataFrame([(1, f"{long} {long} {long}x {long}x " + f"{long} " * 30)], "doc_id long, text string"), every=None)
    assert {(r[0] == long, r[3], r[4]) for r in got} == {(True, 32, 1), (False, 2, 1)}
