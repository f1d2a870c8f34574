"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores, for every document, the postings (sorted positions) of all
terms of the test set.  It is read by a map over the stored rows: an occurrence of a
window's rarest term, moved by the term's offset in the window, is a start, and the
lists of the next rarest terms, moved by theirs, each take out the starts that they do
not hold.  What is left after the last list is an exact match: the texts are read
once, for the index, and never shuffled.  Equal windows are looked up once, and starts
are tried in steps of bounded size, so a word repeated without end in a document and
in an item costs time but no memory.  ``proximity_matches`` uses the same index with a
tolerance instead.

Which terms are rare is counted over all documents.  The test set is taken in
blocks of about ``block_bytes`` of text (one block for any usual benchmark), so
that what is broadcast has a fixed bound while every item meets every row; each
block has its index.

Words: A-Z lower-cased, then runs of characters outside
``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F``.  A window is ``window`` consecutive words of
an item; an item of fewer, but not none, is one window.

Defined results: a null or empty text has no words and no hits.  Repeated rows
get equal results; a null id is kept as a row of its own.  Items without words
never occur; an item with a null id marks words but is not listed.  Empty
tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import ship, slices, written

#: bytes -> lower-cased word bytes or a blank
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
KEY = ["k1", "k2"]


def words_of(body: bytes) -> list[bytes]:
    return body.translate(WORD_BYTES).split()


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """Key of a row: rows with the same id and text share it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.xxhash64(F.col(id_col).isNull(), text)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(k1, k2, doc_id, body) of the rows of ``docs``."""
    k1, k2 = row_key(id_col, text_col)
    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))


class Block:
    """One block of the test set: vocabulary, and items as word numbers."""

    def __init__(self, rows: list[tuple[int | None, bytes]], window: int):
        self.window, self.vocab, self.ids, self.items = window, {}, [], []
        for item_id, body in rows:
            words = words_of(body)
            if words:
                self.ids.append(item_id)
                self.items.append(np.array([self.vocab.setdefault(w, len(self.vocab)) for w in words], dtype=np.int32))


class Windows:
    """The distinct windows of a block of which every term occurs in the corpus,
    grouped by their rarest term.  ``term`` and ``offset`` hold a window's terms from
    the rarest on and their places in it, ``size`` their number."""

    def __init__(self, block: Block, counts: np.ndarray):
        w = block.window
        rows, owner = [np.zeros((0, w), np.int32)], [np.zeros(0, np.int64)]
        for i, words in enumerate(block.items):
            size = min(w, len(words))
            own = np.full((len(words) - size + 1, w), -1, dtype=np.int32)
            own[:, :size] = np.lib.stride_tricks.sliding_window_view(words, size)
            rows.append(own)
            owner.append(np.full(len(own), i))
        table, number = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        often = np.where(table >= 0, np.append(counts, 0)[table], np.iinfo(np.int64).max)
        order = np.argsort(often, axis=1, kind="stable")
        head = np.take_along_axis(table, order, axis=1)[:, 0] if len(table) else np.zeros(0, np.int32)
        live = np.flatnonzero(often.min(axis=1) > 0) if len(table) else np.zeros(0, np.int64)
        live = live[np.argsort(head[live], kind="stable")]
        self.offset = order[live]
        self.term = np.take_along_axis(table[live], self.offset, axis=1)
        self.size = (table[live] >= 0).sum(axis=1)
        # windows of a rarest term: ``per`` of them from ``first`` on; the last place stands for any other word
        self.per = np.append(np.bincount(head[live], minlength=len(block.vocab)), 0).astype(np.int32)
        self.first = np.cumsum(self.per) - self.per
        # items of a window
        rank = np.full(len(table), -1, dtype=np.int64)
        rank[live] = np.arange(len(live))
        pairs = np.unique(np.stack([rank[number.reshape(-1)], np.concatenate(owner)], axis=1), axis=0)
        pairs = pairs[pairs[:, 0] >= 0]
        self.items = pairs[:, 1]
        self.item_first = np.searchsorted(pairs[:, 0], np.arange(len(live) + 1))

    def starts(self, dense: np.ndarray, step: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(start, window) of every occurrence of a window's rarest term, about ``step`` at a time."""
        per = self.per[dense]
        at = np.flatnonzero(per)
        per = per[at].astype(np.int64)
        end = np.cumsum(per)
        a = 0
        while a < len(at):
            before = end[a] - per[a]
            b = max(a + 1, int(np.searchsorted(end, before + step, "right")))
            n = per[a:b]
            window = np.repeat(self.first[dense[at[a:b]]] - (end[a:b] - n - before), n) + np.arange(end[b - 1] - before)
            yield np.repeat(at[a:b], n) - self.offset[window, 0], window
            a = b

    def narrowed(self, dense: np.ndarray, start: np.ndarray, window: np.ndarray, terms: int, slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The starts that the lists of the window's ``terms`` rarest terms hold too, at most ``slop`` words off."""
        for k in range(1, terms):
            if not len(start):
                break
            place, term = start + self.offset[window, k], self.term[window, k]
            held = self.size[window] <= k
            for s in range(-slop, slop + 1):
                held |= dense[place + s] == term
            start, window = start[held], window[held]
        return start, window


def _numbers(body: bytes, get) -> np.ndarray:
    return np.array([get(w, -1) for w in words_of(body)], dtype=np.int32)


def blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[Block]:
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
    total = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(n)) == b)
        yield Block([(r.item_id, bytes(r.body)) for r in part.collect()], window)


def build_index(docs: DataFrame, block: Block) -> DataFrame:
    """(k1, k2, n_words, terms, sizes, positions), stored: a document's terms of the
    block in order, the lengths of their postings, and the postings one after another."""
    sent = docs.sparkSession.sparkContext.broadcast(block.vocab)

    def run(batches):
        get = sent.value.get
        for batch in slices(batches):
            n_words, terms, sizes, positions = [], [], [], []
            for body in batch.column("body"):
                ids = _numbers(body.as_py(), get)
                at = np.flatnonzero(ids >= 0)
                t, n = np.unique(ids[at], return_counts=True)
                n_words.append(len(ids))
                terms.append(t)
                sizes.append(n)
                positions.append(at[np.argsort(ids[at], kind="stable")])
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate(x).astype(np.int32)))
                     for x in (terms, sizes, positions)]
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(n_words, pa.int32()), *lists], names=names)

    names = ["k1", "k2", "n_words", "terms", "sizes", "positions"]
    return written(docs.select("k1", "k2", "body")
                   .mapInArrow(run, "k1 long, k2 long, n_words int, terms array<int>, sizes array<int>, positions array<int>"))


def term_counts(index: DataFrame, block: Block) -> np.ndarray:
    """Occurrences of every term of the block over all documents."""
    size = len(block.vocab)

    def run(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            # exact: the sums of a batch are far below 2 ** 53
            total += np.bincount(batch.column("terms").flatten().to_numpy(), batch.column("sizes").flatten().to_numpy(), minlength=size).astype(np.int64)
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(total[terms])], names=["term", "c"])

    out = np.zeros(size, dtype=np.int64)
    for r in index.select("terms", "sizes").mapInArrow(run, "term int, c long").groupBy("term").agg(F.sum("c").alias("c")).collect():
        out[r.term] = r.c
    return out


def _documents(batches: Iterator[pa.RecordBatch], gap: int, max_words: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(index rows, starts, terms): postings of some documents laid out by position, -1
    where no term of the block stands; ``gap`` empty places around every document."""
    for batch in batches:
        group = np.cumsum(batch.column("n_words").to_numpy().astype(np.int64)) // max_words
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            rows = batch.slice(a, b - a)
            room = rows.column("n_words").to_numpy().astype(np.int64) + gap
            base = gap + np.cumsum(room) - room
            dense = np.full(gap + int(room.sum()), -1, dtype=np.int32)
            held = pc.list_value_length(rows.column("positions")).to_numpy()
            dense[np.repeat(base, held) + rows.column("positions").flatten().to_numpy()] = np.repeat(
                rows.column("terms").flatten().to_numpy(), rows.column("sizes").flatten().to_numpy())
            yield rows, base, dense


def _exact(index: DataFrame, windows: Windows, block: Block) -> DataFrame:
    """(k1, k2, spans, item_ids) of the documents in which a window occurs."""
    sent = index.sparkSession.sparkContext.broadcast((windows, block.ids, block.window))

    def run(batches):
        w, names, size = sent.value
        for rows, base, dense in _documents(batches, size):
            edge, seen = np.zeros(len(dense) + 1, dtype=np.int64), [np.zeros(0, np.int64)]
            for start, window in w.starts(dense):
                start, window = w.narrowed(dense, start, window, size)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + w.size[window], -1)
                seen.append(np.unique((np.searchsorted(base, start, "right") - 1) * len(w.size) + window))
            seen = np.unique(np.concatenate(seen))
            if not len(seen):
                continue
            hit = np.concatenate([[0], np.cumsum(edge[:-1]) > 0, [0]]).astype(np.int8)
            first, end = np.flatnonzero(np.diff(hit) == 1), np.flatnonzero(np.diff(hit) == -1)
            doc, window = np.divmod(seen, len(w.size))
            docs, cut_at = np.unique(doc, return_index=True)
            spans, listed = [], []
            for d, own in zip(docs, np.split(window, cut_at[1:]), strict=True):
                a, b = np.searchsorted(first, [base[d], base[d + 1] if d + 1 < len(base) else len(dense)])
                spans.append([{"s": int(s - base[d]), "e": int(e - base[d])} for s, e in zip(first[a:b], end[a:b], strict=True)])
                items = {int(i) for x in own for i in w.items[w.item_first[x]:w.item_first[x + 1]]}
                listed.append(sorted({names[i] for i in items if names[i] is not None}))
            take = pa.array(docs)
            yield pa.RecordBatch.from_arrays(
                [rows.column("k1").take(take), rows.column("k2").take(take),
                 pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(listed, pa.list_(pa.int64()))],
                names=["k1", "k2", "spans", "item_ids"])

    return (index.select("k1", "k2", "n_words", "terms", "sizes", "positions")
            .mapInArrow(run, "k1 long, k2 long, spans array<struct<s:int,e:int>>, item_ids array<long>").dropDuplicates(KEY))


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = 10, block_bytes: int = 2 << 20) -> tuple[DataFrame, DataFrame]:
    """Lengths (k1, k2, n_words) of all documents, and (k1, k2, spans, item_ids)
    of those in which a window of an item occurs; spans are word ranges [s, e),
    sorted and disjoint, over all items."""
    ship(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    lengths, hits = None, None
    for block in blocks(items, item_id, item_text, window, block_bytes):
        index = build_index(rows, block)
        if lengths is None:
            lengths = index.select("k1", "k2", "n_words")
        own = _exact(index, Windows(block, term_counts(index, block)), block)
        hits = own if hits is None else hits.unionByName(own)
    merged = hits.groupBy(*KEY).agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"),
                                    F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"))
    joined = F.expr("""aggregate(spans, cast(array() as array<struct<s:int,e:int>>), (acc, x) ->
        case when size(acc) > 0 and element_at(acc, -1).e >= x.s
             then concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).s as s, greatest(element_at(acc, -1).e, x.e) as e)))
             else concat(acc, array(x)) end)""")
    return lengths.dropDuplicates(KEY), merged.withColumn("spans", joined)


def proximity_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                      item_text: str = "text", window: int = 10, terms: int = 3, slop: int = 5, block_bytes: int = 2 << 20) -> DataFrame:
    """(doc key k1, k2, item_id, start): an occurrence of a window's rarest term
    with each of the window's other ``terms - 1`` rarest terms at most ``slop``
    words from its place in the item, in any order."""
    ship(docs.sparkSession)
    rows, out = keyed(docs, id_col, text_col), None
    for block in blocks(items, item_id, item_text, window, block_bytes):
        index = build_index(rows, block)
        sent = docs.sparkSession.sparkContext.broadcast((Windows(block, term_counts(index, block)), np.array([-1 if i is None else i for i in block.ids], dtype=np.int64),
                                                         np.array([i is None for i in block.ids], dtype=bool)))

        def run(batches, sent=sent):
            w, names, unnamed = sent.value
            for found, base, dense in _documents(batches, window + slop):
                for start, own in w.starts(dense):
                    start, own = w.narrowed(dense, start, own, min(terms, window), slop)
                    n = w.item_first[own + 1] - w.item_first[own]
                    item = w.items[np.repeat(w.item_first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    doc = np.searchsorted(base, np.repeat(start, n) + window - 1, "right") - 1
                    take = pa.array(doc)
                    yield pa.RecordBatch.from_arrays([found.column("k1").take(take), found.column("k2").take(take), pa.array(names[item], mask=unnamed[item]),
                                                      pa.array(np.repeat(start, n) - base[doc])], names=["k1", "k2", "item_id", "start"])

        own = index.select("k1", "k2", "n_words", "terms", "sizes", "positions").mapInArrow(run, "k1 long, k2 long, item_id long, start long").distinct()
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256
    (of the sorted item ids), contaminated, and the hit word ranges (spans)."""
    lengths, hits = phrase_matches(docs, items, id_col, text_col, window=window)
    rows = keyed(docs, id_col, text_col).select("k1", "k2", "doc_id")
    names = F.array_sort(F.transform("item_ids", lambda x: x.cast("string")))
    per_doc = lengths.join(hits.select("k1", "k2", "spans", names.alias("names")), KEY, "left")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["e"] - x["s"]).cast("long"))
    return rows.join(per_doc, KEY).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce(n_hit, F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"), "spans")
