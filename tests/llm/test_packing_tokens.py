import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from binsight.llm import curve_packing as cp  # noqa: E402
from binsight.llm import token_counts as tc  # noqa: E402

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(n=1500):
    rng = random.Random(2)
    fixed = ["", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>  <|endoftext|>", "don't we'LL it's 'S ''s", "a  b\n\n c\r\n\t d   ", "\t\t x\n",
             "Ünïcode É ×÷ ß ſ ŉ İ ı ǆ", "İstanbul ΑΣ Σ ΟΔΟΣ.", "日本語テスト 中文 한국어", "1234 ½ ٣ Ⅷ", "\U0001f600\U0001f44d\U0001f3fd", "a\x1cb\x1d c", "x y z　w\x85v",
             "a" * 3000, " " * 300, "zzzz " * 50, "<|endoftext", "\x00\x01", "á̧ ́abc", "__ -- ''' !!!???"]
    ranges = [(32, 127)] * 3 + [(0x80, 0x250), (0x300, 0x370), (0x370, 0x5FF), (0x1E00, 0x2100), (9, 14)]
    return fixed + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_token_counts_equal_the_library():
    library, own = tokenizers.Tokenizer.from_file(WORD), tc.Counter(WORD)
    texts = odd_texts()
    assert own.batch(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_overlapping_pairs_merge_from_the_left():
    model = {"vocab": {"a": 0, "a</w>": 1, "aa": 2, "aa</w>": 3, "aaaa</w>": 4}, "merges": [["a", "a"], ["a", "a</w>"], ["aa", "aa</w>"]], "end_of_word_suffix": "</w>"}
    merger = tc.RankMerger(model)
    pieces = ["a", "aa", "aaa", "aaaa", "aaaaa"]
    assert merger.counts(*merger.ragged(pieces), len(pieces)).tolist() == [1, 1, 2, 1, 3]


def test_remembered_counts_are_dropped_at_the_bound(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED", 50)
    library, own = tokenizers.Tokenizer.from_file(WORD), tc.Counter(WORD)
    for t in odd_texts(200):
        assert own.batch([t])[0] == len(library.encode(t, add_special_tokens=False).ids)
        assert len(own.seen) <= max(50, len(t.split()))


def test_remembered_characters_are_bounded(monkeypatch):
    monkeypatch.setattr(tc, "REMEMBERED_CHARS", 5000)
    rng = random.Random(8)
    library, own = tokenizers.Tokenizer.from_file(WORD), tc.Counter(WORD)
    for _ in range(30):
        t = "".join(rng.choice("一二三四五六七八") for _ in range(1500)) + " " + "".join(rng.choice("QRSTUV09+/") for _ in range(800))
        assert own.batch([t, t])[1] == len(library.encode(t, add_special_tokens=False).ids)
        assert sum(map(len, own.seen)) == own.seen_chars <= 5000


def test_pre_tokens_of_any_length(monkeypatch):
    rng = random.Random(3)
    library, texts = tokenizers.Tokenizer.from_file(WORD), ["".join(rng.choice("abcdeé") for _ in range(n)) for n in (1, 50, 3000, 25_000)]
    want = [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert tc.Counter(WORD).batch(texts).tolist() == want
    monkeypatch.setattr(tc, "LONGEST", 40)
    assert tc.Counter(WORD).batch([" ".join(texts), *texts]).tolist() == [sum(want), *want]


def test_token_count_query_on_edge_rows(spark, edge_docs, edge_rows):
    library = tokenizers.Tokenizer.from_file(WORD)
    got = tc.token_counts(edge_docs, WORD).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in edge_rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert tc.token_counts(edge_docs.limit(0), WORD).count() == 0


def test_ids_equal_the_library():
    library, own = tokenizers.Tokenizer.from_file(BYTE), cp.ids_of(BYTE)
    for t in odd_texts():
        assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


@pytest.mark.parametrize("blank", [" ", "\n", "\r\n", "\t "])
def test_ids_of_very_long_white_space(blank):
    library, own = tokenizers.Tokenizer.from_file(BYTE), cp.ids_of(BYTE)
    for n in (100_000, 100_001, 2_000_000):
        for t in ("a" + (blank * n)[:n] + "b", (blank * n)[:n]):
            assert own(t).tolist() == library.encode(t, add_special_tokens=False).ids, (blank, n)


@pytest.mark.parametrize("dims,bits", [(2, 5), (3, 3), (4, 2)])
def test_hilbert_index_visits_neighbouring_cells(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    key = cp.hilbert_index(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1).max() == 1


def check_packing(rows, texts, length=1024):
    """rows: pieces; texts: ids of each document row, by position in the rows' ids."""
    docs, sequences = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == length or (at < length and at & (at - 1) == 0)
    for doc, own in texts.items():
        want = sorted((s, c) for ids in own for s, c in [(len(ids), zlib.crc32(ids.tobytes()))])
        assert sum(r.length for r in docs[doc]) == sum(n for n, _ in want)
        assert sum(r.start == 0 for r in docs[doc]) == len(want)
        if len(own) == 1:
            at = 0
            for r in sorted(docs[doc], key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(own[0]))
                assert r.ids_crc32 == zlib.crc32(own[0][at:at + r.length].tobytes())
                at += r.length
    assert set(docs) == set(texts)


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_pieces_cover_every_document(spark, edge_docs, edge_rows, ranges):
    library = tokenizers.Tokenizer.from_file(BYTE)
    texts = {}
    for i, t in edge_rows:
        texts.setdefault(i, []).append(np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4"))
    check_packing(cp.pack(edge_docs, BYTE, ranges=ranges).collect(), texts)


def test_packing_of_an_empty_table_and_of_many_copies(spark, edge_docs):
    assert cp.pack(edge_docs.limit(0), BYTE).count() == 0
    copies = spark.range(500).selectExpr("id as doc_id", "'the same words again' as text")
    rows = cp.pack(copies, BYTE, ranges=6).collect()
    assert len({r.sequence_id >> 40 for r in rows}) > 3            # one key, several ranges
    assert len({r.doc_id for r in rows}) == 500


def test_range_bounds_balance_all_rows(spark):
    """No sample: ranges hold about the same weight, hot positions and hot prefixes included."""
    rng = random.Random(6)
    top = 1 << cp.POSITION_BITS
    rows = [(rng.randrange(top), 10) for _ in range(3000)] + [(top // 3 + rng.randrange(1 << 20), 10) for _ in range(3000)]       # a third under one prefix
    rows += [(top - 1, 1)] * 5 + [(0, 1)]
    df = spark.createDataFrame(rows, "pos long, weight long")
    bounds = np.array(cp.bounds_of(df, 7))
    share = np.bincount(np.searchsorted(bounds, [p for p, _ in rows], "right"), [w for _, w in rows])
    assert len(bounds) == 6 and share.max() < 1.3 * share.mean() and share.min() > 0.7 * share.mean()
    hot = spark.createDataFrame([(5, 1000)] * 400 + rows, "pos long, weight long")
    bounds = cp.bounds_of(hot, 7)
    share = np.bincount(np.searchsorted(bounds, [5] * 400 + [p for p, _ in rows], "right"), [1000] * 400 + [w for _, w in rows])
    assert share[0] <= 410_000 and bounds == sorted(set(bounds))        # one position is one range at most
    assert cp.bounds_of(df.limit(0), 7) == []


def test_positions_keep_the_order_of_keys():
    key = np.array([0, 1, 1, (1 << cp.DIMS * cp.BITS) - 1])
    tie = np.array([-1, 3, -3, 2 ** 62], dtype=np.int64)
    at = cp.positions(key, tie)
    assert (at >= 0).all() and (at >> cp.TIE_BITS == key).all() and at[1] < at[2] and at.max() < 1 << cp.POSITION_BITS


def test_neighbours_on_the_curve_share_sequences(spark, vocabulary):
    """Two kinds of text, interleaved by id: sequences hold mostly one kind."""
    rng = random.Random(1)
    kinds = [vocabulary[:12], vocabulary[12:24]]
    rows = [(i, " ".join(rng.choice(kinds[i % 2]) for _ in range(60))) for i in range(200)]
    got = cp.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTE, ranges=2).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append(r.doc_id % 2)
    pure = sum(max(v.count(0), v.count(1)) for v in by.values()) / len(got)
    assert pure > 0.9
