import hashlib
import random
import re

import pytest

from binsight.llm import trie_dedup as td


def brute(rows):
    texts = [re.sub("[ \t-\r]+", " ", t or "") for _, t in rows]
    groups = {}
    for (doc, _), t in zip(rows, texts, strict=True):
        groups.setdefault(t, []).append(doc)
    out = []
    for t, ids in groups.items():
        low = min((i for i in ids if i is not None), default=None)
        for at, i in enumerate(sorted(ids, key=lambda i: (i is None, i))):
            out.append((i, low, len(ids), at == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


def result(docs, **kw):
    return sorted(repr(tuple(r)) for r in td.exact_copies(docs, **kw).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def test_trie_holds_what_was_inserted():
    rng = random.Random(1)
    texts = list({bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(600)})
    trie = td.Trie()
    for t in texts * 2:
        node = trie.terminal(t)
        node.own = [t]
    walked = {prefix + n.label: n.own[0] for n, prefix in td._walk(trie.root, b"") if n.own is not None}
    assert walked == {t: t for t in texts}
    # compressed: an inner node that ends no text has two children at least
    assert all(n.own is not None or len(n.children) > 1 or n is trie.root for n, _ in td._walk(trie.root, b""))


def test_spilled_subtrees_take_their_later_texts_along():
    rng = random.Random(2)
    texts = list({bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 9))) for _ in range(400)})
    trie, out = td.Trie(), []
    for i, t in enumerate(texts):
        node = trie.terminal(t)
        if node.spilled:
            out.append(t)
            continue
        node.own = [t]
        if i % 90 == 89:
            out += [text for text, own in trie.spill() if own == [text]]
    stay = [own[0] for own in trie.owners()]
    assert sorted(out + stay) == sorted(texts) and out and stay
    while list(trie.spill()):
        pass
    assert len(list(trie.owners())) <= 1          # a single path can not spill


@pytest.mark.parametrize("limits", [{}, {"chunk_rows": 7, "chunk_bytes": 4000, "max_bytes": 3000}])
def test_against_brute_force(spark, vocabulary, limits):
    rng = random.Random(3)
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 40))) for _ in range(120)]
    rows = [(i, rng.choice(base[:1] * 40 + base)) for i in range(400)]
    rows += [(i, t.replace(" ", rng.choice(["  ", "\n", " \t", "\x0b"]))) for i, t in enumerate(base, 1000)]
    rows += [(2000, " " + base[1]), (2001, base[1] + " "), (2002, " "), (2003, "\u0085"), (2004, base[2].upper())]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert result(docs, **limits) == brute(rows)


def test_rounds_end_when_nothing_fits(spark):
    rows = [(i, f"{i % 40:03d}" * 200) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(docs, max_bytes=1) == brute(rows)


def test_edges(spark, edge_docs, edge_rows):
    assert result(edge_docs) == brute(edge_rows)
    assert result(spark.createDataFrame([], "doc_id long, text string")) == []


def test_same_length_and_hash_are_not_enough(spark, monkeypatch):
    """Texts that a partition's key can not tell apart are told apart by their bytes."""
    trie = td.Trie()
    a, b = trie.terminal(b"same length a"), trie.terminal(b"same length b")
    assert a is not b and trie.terminal(b"same length a") is a
