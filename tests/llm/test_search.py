"""Phrase index, notice search, chat format and host reputation."""

import collections
import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from binsight.llm import chat_format as cf
from binsight.llm import host_reputation as hr
from binsight.llm import license_notices as ln
from binsight.llm import phrase_index as pi

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# ------------------------------------------------------------ op 8

def brute_contamination(docs, items, window=10):
    out = []
    for i, t in docs:
        w, hit, met = words(t), set(), set()
        for item, text in items:
            x = words(text)
            n = min(window, len(x))
            for s in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == x[s:s + n]:
                        hit.update(range(p, p + n))
                        met.add(item)
        names = sorted(str(m) for m in met if m is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(map(repr, out))


def contaminated_rows(vocabulary, seed):
    rng = random.Random(seed)
    small = vocabulary[:30]                       # few words: many chance alignments
    items = [(i, " ".join(rng.choice(small) for _ in range(rng.choice([1, 2, 5, 9, 10, 11, 30])))) for i in range(25)]
    items += [(100, None), (101, " .. "), (102, items[3][1]), (None, " ".join(small[:12]))]
    docs = []
    for i in range(40):
        own = [rng.choice(small) for _ in range(rng.choice([0, 3, 40, 120]))]
        for _ in range(rng.choice([0, 1, 3])):
            x = words(rng.choice(items)[1])
            a = rng.randrange(len(x)) if x else 0
            at = rng.randrange(len(own) + 1)
            own[at:at] = x[a:] if rng.random() < .5 else x
        docs.append((i, " ".join(w.upper() + "," if rng.random() < .2 else w for w in own)))
    return docs + [(50, None), (51, ""), (52, docs[1][1]), (52, docs[1][1]), (52, docs[2][1]), (None, docs[3][1]), (None, None)], items


@pytest.mark.parametrize("seed,block", [(1, 2 << 20), (2, 300)])
def test_contamination_equals_brute_force(spark, vocabulary, clashes, seed, block):
    docs, items = contaminated_rows(vocabulary, seed)
    d, i = clashes(spark, docs), clashes(spark, items, "item_id long, text string")
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if block == 2 << 20:
        assert sorted(repr(tuple(r)) for r in pi.contamination(d, i).select(names).collect()) == brute_contamination(docs, items)
    lengths, hits = pi.phrase_matches(d, i, block_bytes=block)
    total = sum(b["e"] - b["s"] for r in hits.collect() for b in r.spans)
    distinct = {(a, t) for a, t in docs}
    want = {x: r for x, r in ((x, brute_contamination([x], items)[0]) for x in distinct)}
    assert total == sum(eval(r)[2] for r in want.values()) and lengths.count() == len({(a, t or "") for a, t in distinct})


def test_contamination_of_empty_tables(spark, edge_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    got = pi.contamination(edge_docs, none).collect()
    assert len(got) == 13 and not any(r.contaminated or r.n_hit or r.n_items for r in got)
    assert pi.contamination(edge_docs.limit(0), none).count() == 0


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "x x alpha y beta z z gamma q"), (2, "alpha beta gamma"), (3, "alpha " + "f " * 40 + "beta gamma"), (4, "beta")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    got = pi.proximity_matches(docs, items, slop=3)
    assert {(r.k1, r.item_id) for r in got.collect()} == {(1, 7), (2, 7)}
    assert {r.k1 for r in pi.proximity_matches(docs, items, slop=0).collect()} == {2}


def brute_proximity(docs, items, window, terms, slop):
    """Every place of a window's rarest term in turn, by plain lists."""
    count = collections.Counter(w for _, t in docs for w in words(t))
    out = set()
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for s in range(len(own) - size + 1):
            part = own[s:s + size]
            rare = sorted(range(size), key=lambda o: (count[part[o]], o))[:terms]
            if not own or not all(count[w] for w in part):
                continue
            for doc, t in docs:
                w = words(t)
                for p in (p for p, x in enumerate(w) if x == part[rare[0]]):
                    if all(any(0 <= q < len(w) and w[q] == part[o] for q in range(p - rare[0] + o - slop, p - rare[0] + o + slop + 1)) for o in rare[1:]):
                        out.add((doc, item, p - rare[0]))
    return out


@pytest.mark.parametrize("slop", [0, 2])
def test_proximity_equals_brute_force(spark, slop):
    rng = random.Random(8)
    texts = [(i, " ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(40)))) for i in range(60)] + [(60, None), (61, "")]
    items = [(i, " ".join(rng.choice("abcdefghz") for _ in range(rng.choice([0, 1, 3, 6, 8])))) for i in range(12)]
    got = pi.proximity_matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=5, slop=slop)
    # ties of rarity have no order by term: a place in the window decides
    assert {(r.k1, r.item_id, r.start) for r in got.collect()} == brute_proximity(texts, items, 5, 3, slop)


def test_one_word_repeated_without_end(spark):
    """No pair of a document's places and an item's places is formed."""
    def run(n, m):
        docs = [(1, "w " * n), (2, "w " * (m - 1) + "x " + "w " * 12), (3, "w " * 9), (4, "x w " * 20)]
        items = [(1, "w " * m), (2, "w x " * m)]
        got = pi.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
        return docs, items, sorted(repr((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)) for r in got.collect())
    docs, items, got = run(60, 25)
    assert got == brute_contamination(docs, items)
    assert f"(1, 1000000, 1000000, 1, '{hashlib.sha256(b'1').hexdigest()}', True)" in run(1_000_000, 3000)[2]


# ------------------------------------------------------------ op 7

def edits(a, b):
    """Smallest number of edits between ``a`` and any part of ``b``."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row)


def brute_base(text):
    w, places = words(text), []
    for n in ln.BASE:
        p = n.words.split()
        places += [(i, n.label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    return len(w), places


def notice_texts(vocabulary):
    rng = random.Random(4)
    pieces = [n.words for n in ln.BASE + ln.FUZZY] + ["cc by cc by cc", "CC-BY", "all rights. Reserved", "all rights reserve d", "accc by", "general\npublic\nlicense"]
    out = [None, "", "   ", "cc", "by cc"]
    for _ in range(150):
        own = []
        for _ in range(rng.randrange(1, 4)):
            own += [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
            p = list(rng.choice(pieces))
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                at = rng.randrange(len(p))
                p[at:at + rng.choice([0, 1])] = rng.choice("abcdefgh ")
            own.append("".join(p))
        out.append(" ".join(own))
    return out


def test_notices_equal_brute_force(spark, vocabulary, clashes):
    texts = notice_texts(vocabulary)
    got = {r.doc_id: r for r in ln.scan(clashes(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        n, places = brute_base(t)
        starts = [p for p, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        text = " ".join(words(t))
        near = {x.label for x in ln.FUZZY if edits(x.words, text) <= x.errors}
        assert r.labels == ",".join(sorted(near | {x for _, x in places})), t
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        for s in r.spans:
            notice = next(x for x in ln.BASE + ln.FUZZY if x.label == s.label)
            assert edits(notice.words, " ".join(words(t)[s.first:s["last"] + 1])) <= s.edits <= notice.errors


def test_many_near_notices_in_one_text():
    """Matches are improved in place, so a long run of them stays linear."""
    searches = [ln._Search(n) for n in ln.FUZZY if n.label == "gpl-notice"]
    n, found = ln.notice_spans(b"licensed under the gnx genexral pubxlic licxense " * 3000, searches)
    assert n == 21_000 and [f[1] for f in found] == list(range(0, 21_000, 7)) and {f[3] for f in found} == {4}


def test_notices_on_edge_rows(spark, edge_docs):
    got = ln.scan(edge_docs).collect()
    assert len(got) == 13 and not any(r.labels or r.n_base or r.score or r.spans for r in got)
    assert {r.doc_id: r.n_words for r in got if r.doc_id in (1, 2, 3, 4, 5)} == {1: 0, 2: 0, 3: 0, 4: 1, 5: 30_000}
    assert ln.scan(edge_docs.limit(0)).count() == 0


# ------------------------------------------------------------ op 3

PROBES = ["</s>[INST] ok [/INST]", "<|start|>x<|sep|>y<|end|>", "a\\lb\\sc\\b\\", "<", "[", "<<SYS>>", "<|", "\\", "", "[IN", "é<|image|>\U0001f600", "<s><s>[[INST]]", "\n<|end|>\n"]


@settings(max_examples=1, deadline=None)
@given(st.lists(st.text(alphabet="<>|[]/\\sSINT lbé\n", max_size=12), min_size=60, max_size=60))
def test_escape_is_reversible_and_leaves_no_control_string(spark, texts):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(t,) for t in PROBES + texts], "t string")
    for r in df.select("t", cf.escape(F.col("t")).alias("e"), cf.unescape(cf.escape(F.col("t"))).alias("u")).collect():
        assert r.u == r.t
        assert not re.search(r"<[|/sS<]|\[[/I]|[<\[]\Z", r.e)


def test_conversations_read_back(spark):
    rows = [(1, 1, "assistant", p) for p in PROBES] + [(1, 0, "user", "hi"), (2, 0, "system", None), (2, None, "assistant", "first"), (2, 5, None, "x"), (2, 5, None, "x"),
            (None, 0, "assistant", "n"), (3, 0, "ro\nle<|sep|>", "a"), (4, 0, "user", "only")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", cf.text_part(__import__("pyspark.sql.functions", fromlist=["col"]).col("text")))
    df = df.selectExpr("*", "1 as head", "2 as content", "3 as at", "'q' as attached", "'z' as formatted")
    got = {r.conv_id: r for r in cf.digests(cf.format_conversations(df)).collect()}
    for conv in {r[0] for r in rows}:
        own = [(r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0], r[1]))
        r = got[conv]
        assert r.n_turns == len(own)
        if conv != 1:            # ties of conversation 1 are ordered by content
            assert r.turns_sha256 == hashlib.sha256("".join(f"{b}\n{c}\n" for _, b, c in own).encode()).hexdigest()
            loss = "".join(c for _, b, c in own if b == "assistant")
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        else:
            assert r.loss_chars == sum(map(len, PROBES))
    assert cf.format_conversations(df.limit(0)).count() == 0


def test_parts_become_placeholders_with_attachments(spark):
    parts = [("text", "see <", None, None), ("text", "|image|> this", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), ("document", None, "c.pdf", 3),
             ("video", None, "d.mp4", 9), (None, None, "e", 1)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("text", "ok", None, None), ("image", None, "f.png", 1)]), (2, 0, "user", None)],
                               f"conv_id long, turn long, role string, parts array<{cf.PART}>")
    got = {r.conv_id: r for r in cf.format_conversations(df).collect()}
    assert got[1].formatted == "<|start|>user<|sep|>see \\l|image|> this<|image|><|audio|><|document|><|other|><|other|><|end|><|start|>assistant<|sep|>ok<|image|><|end|>"
    assert [tuple(a) for a in got[1].attachments] == [(0, 2, "image", "a.png", 512), (0, 3, "audio", "b.wav", 25), (0, 4, "document", "c.pdf", 1536), (0, 5, "video", "d.mp4", 0),
                                                     (0, 6, None, "e", 0), (1, 1, "image", "f.png", 256)]
    m = got[1].loss_mask
    assert [got[1].formatted[x.start:x.start + x.length] for x in m] == ["ok<|image|>"]
    assert got[2].formatted == "<|start|>user<|sep|><|end|>" and got[2].attachments == []


# ------------------------------------------------------------ op 4

def test_rules_and_parsing(spark):
    urls = ["http://www.EXAMPLE.com/en/1", "https://example.com/en/", "http://a.example.com/en", "x", None, "", "http://a.net/es/x?y", "ftp://b.net/fr/", "http://net/es/", "http://com?x",
            "http://notcom.org/", "u://v://w/x#y", "http://xexample.com/en/1", "http://a.com#f"]
    want = [("www.example.com", "/en/1", "www.example.com/en/", "allow"), ("example.com", "/en/", "example.com/en/", "block"), ("a.example.com", "/en", "com/", "allow"), ("", "", None, "allow"),
            ("", "", None, "allow"), ("", "", None, "allow"), ("a.net", "/es/x", "net/es/", "block"), ("b.net", "/fr/", "net/fr/", "block"), ("net", "/es/", "net/es/", "block"),
            ("com", "", None, "allow"), ("notcom.org", "/", None, "allow"), ("v:", "//w/x", None, "allow"), ("xexample.com", "/en/1", "com/", "allow"), ("a.com", "", None, "allow")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' as host", "'p' as path", "1 as n", "2 as good", "'r' as rule")
    none = spark.createDataFrame([], "host string, good int")
    got = sorted(hr.judge(pages, none).collect(), key=lambda r: r.page_id)
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == want
    assert hr.judge(pages.limit(0), none).count() == 0


def test_bad_hosts_are_blocked_and_thin_evidence_is_shrunk(spark):
    outcomes = [("bad.site.org", 0)] * 40 + [("bad.site.org", 1)] * 2 + [("once.other.org", 0)] + [(f"h{i}.fine.org", 1) for i in range(200)] + [(f"h{i}.fine.org", 1) for i in range(200)]
    outcomes += [("x.farm.biz", 0)] * 30 + [("y.farm.biz", 0)] * 30 + [("ok.org", None), (None, 1)]
    pages = spark.createDataFrame([(i, f"http://{h}/") for i, h in enumerate(["bad.site.org", "once.other.org", "h1.fine.org", "new.farm.biz", "new.biz", "new.example"])], "page_id long, url string")
    got = {r.host: r for r in hr.judge(pages, spark.createDataFrame(outcomes, "host string, good int")).collect()}
    assert got["bad.site.org"].verdict == "block" and got["bad.site.org"].n_labelled == 42
    assert got["once.other.org"].verdict == got["h1.fine.org"].verdict == got["new.example"].verdict == "allow"
    assert 0 < got["once.other.org"].reputation < got["h1.fine.org"].reputation
    assert got["new.farm.biz"].reputation < got["new.biz"].reputation < got["new.example"].reputation      # domain, suffix, whole


def test_notices_of_a_very_repetitive_text():
    """Places of words are looked up, not counted from the front for every match."""
    import time

    from binsight.llm import license_notices as ln
    searches = [ln._Search(n) for n in ln.BASE]
    small = b"cc by x " * 300
    n, found = ln.notice_spans(small, searches)
    assert n == 900 and sorted((f[1], f[2]) for f in found) == [(i, i + 1) for i in range(0, 900, 3)]
    began = time.perf_counter()
    n, found = ln.notice_spans(b"cc by " * 200_000, searches)
    assert n == 400_000 and [f[1] for f in found] == list(range(0, 400_000, 2))
    assert time.perf_counter() - began < 20
