"""Grouping of spelling variants by pivotal grams.

Words are near if one inserted, deleted or replaced code point turns one into
the other.  Near words are found with the pivotal prefix filter:

* All bigrams have one order, rarest first, by the number of words that hold
  them.  The *prefix* of a word are its grams up to the rank of its third one; of
  a gram of that last rank, which a word may repeat without end, the first and the
  last few occurrences (one edit makes or destroys two at most, so an occurrence
  among the first three of one word is among the first five of the other).
* From its prefix a word chooses two disjoint grams of least total frequency by
  dynamic programming along the word: its *pivots*.
* One edit destroys one pivot at most.  So of two near words, the one whose
  prefix ends earlier has a pivot that stands in the other's prefix, at the same
  place or moved by the difference of the lengths.  Pivots are therefore looked
  up in an index of all prefix grams, by gram, place and length.
* The edit lies on one side of a surviving pivot (right of the first or left of
  the second), so what stands on the other side is equal; and in one half of its
  side, so the other half is equal too.  The index key holds these parts, which
  keeps its groups small: words of a group agree in more than half of their
  letters, not in a gram alone.
* Candidates of a key are verified by edit distance within the join.

The gram table has at most 8,100 rows (90 letters, squared); nothing else is
broadcast.  Words are counted within tasks before they are shuffled.  A near
word's groups are joins on hashed keys, whose skewed partitions Spark can split.

Defined results: null texts hold no words; words that are repeated within and
across rows count every time; a null id counts as empty text in the hash that
alters words.  Texts of any length are cut at word ends into pieces that bound
memory.  An empty table, or one without words, gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import ship, slices, written

#: letters of a word once A-Z are lower-cased
LETTERS = "a-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
#: one run in so many loses a code point (a fixed value of the registered query)
ALTERED = 31
#: words that a task counts before it hands them on, and letters of a text looked at at a time
_COUNTED, _PIECE = 200_000, 1 << 20
#: bytes of keyed rows that a task hands on at a time
_BATCH = 4 << 20


def _pieces(text: str, letter: re.Pattern) -> Iterator[str]:
    """``text`` in pieces of about ``_PIECE`` characters that end where a word does."""
    at = 0
    while len(text) - at > _PIECE:
        end = letter.match(text, at + _PIECE).end()
        yield text[at:end]
        at = end
    yield text[at:]


def altered(word: str, seed: int, every: int) -> str:
    """``word`` without one code point if its hash (``seed``: that of what stands before it) says so."""
    h = zlib.crc32(word.encode(), seed)
    if h % every:
        return word
    i = h % len(word)
    return word[:i] + word[i + 1:]


def _count(min_length: int, every: int | None):
    def run(batches):
        word_re, rest_re = re.compile(f"[{LETTERS}]+"), re.compile(f"[{LETTERS}]*")
        total: dict[str, int] = {}

        def found():
            words = list(total)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([total[w] for w in words], pa.int64())], names=["word", "n"])
            total.clear()
            return batch

        for batch in slices(batches):
            for doc, body in zip(batch.column("doc_id").to_pylist(), batch.column("body"), strict=True):
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # bytes: lower-cases A-Z only; what is no UTF-8 is no letter
                for piece in _pieces(body.as_py().lower().decode("utf-8", "replace"), rest_re):
                    for word, n in Counter(word_re.findall(piece)).items():
                        if len(word) >= min_length:
                            if every:
                                word = altered(word, seed, every)
                                if len(word) < min_length:
                                    continue
                            total[word] = total.get(word, 0) + n
                if len(total) >= _COUNTED:
                    yield found()
        yield found()
    return run


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
                every: int | None = ALTERED) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points with at least
    ``min_count`` occurrences; ``every=None`` counts the words as they are written."""
    ship(docs.sparkSession)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).cast("binary").alias("body"))
    return (rows.mapInArrow(_count(min_length, every), "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))


def gram_counts(words: DataFrame) -> dict[str, int]:
    """gram -> number of words that hold it; at most the square of the letters' number."""
    def run(batches):
        for batch in batches:
            held = Counter(g for w in batch.column("word").to_pylist() for g in {w[i:i + 2] for i in range(len(w) - 1)})
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["gram", "n"])

    return {r["gram"]: r["n"] for r in words.select("word").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}


def _prefix(ranks: list[int], last: int, each: int) -> list[int]:
    """Places of the grams of a rank before ``last`` (two at most), and of the first and the
    last ``each`` of rank ``last``."""
    ends = [i for i, r in enumerate(ranks) if r == last]
    return sorted({i for i, r in enumerate(ranks) if r < last} | set(ends[:each]) | set(ends[-each:]))


def pivots(word: str, held: dict[str, int], rank: dict[str, int]) -> tuple[int, list[int], tuple[int, int]]:
    """(rank that ends the prefix, places of the prefix's grams for the index, places of the two pivots)."""
    ranks = [rank[word[i:i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[2]
    own = _prefix(ranks, last, 3)
    best = pair = None          # cheapest gram that ends before the current one, cheapest pair
    late = 0
    for i in own:
        while own[late] <= i - 2:
            cost = held[word[own[late]:own[late] + 2]]
            if best is None or cost < best[0]:
                best = (cost, own[late])
            late += 1
        if best is not None:
            cost = best[0] + held[word[i:i + 2]]
            if pair is None or cost < pair[0]:
                pair = (cost, best[1], i)
    return last, _prefix(ranks, last, 5), (pair[1], pair[2])


# Keys of a gram at place x of a word that is compared as one of n letters.  The gram
# survives.  Edit to its right: what is left of it is equal, and so is one half of what
# follows; edit to its left: the same in the mirror.  Halves are cut by x and n alone, so
# both words know them.  ``a`` is the word itself, whose length may differ from n.

def _right_of(a: str, x: int, n: int) -> tuple[tuple, tuple]:
    half = x + 2 + (n - x - 2) // 2
    return ("later half", n, x, a[:x + 2], a[len(a) - (n - half):]), ("earlier half", n, x, a[:half])


def _left_of(a: str, x: int, n: int) -> tuple[tuple, tuple]:
    """``x``: place of the gram in the word of n letters, counted from its end."""
    half = (n - x) // 2
    return ("first half", n, x, a[:half], a[len(a) - x:]), ("second half", n, x, a[len(a) - (n - half):])


def _index_keys(word: str, prefix: list[int]) -> set[tuple]:
    n = len(word)
    return {key for x in prefix for key in (*_right_of(word, x, n), *_left_of(word, n - x, n))}


def _pivot_keys(word: str, first: int, second: int) -> set[tuple]:
    own = len(word)
    return {key for n in (own - 1, own, own + 1) for key in (*(_right_of(word, first, n) if first + 2 <= n else ()),
                                                            *(_left_of(word, own - second, n) if own - second <= n else ()))}


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"key": pa.int64(), "word": pa.string(), "n": pa.int64(), "last": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def _keyed(held: dict[str, int], index: bool):
    """Words -> a row for each key of their prefix grams (``index``) or of their pivots."""
    import xxhash

    def run(batches):
        rank = {g: i for i, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
        for batch in slices(batches, body="word"):
            rows, size = [], 0
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                last, prefix, (first, second) = pivots(word, held, rank)
                for key in _index_keys(word, prefix) if index else _pivot_keys(word, first, second):
                    rows.append((xxhash.xxh64_intdigest("\0".join(map(str, key)).encode()) - (1 << 63), word, n, last))
                    size += 64 + len(word)
                    if size >= _BATCH:
                        yield _rows(rows)
                        rows, size = [], 0
            yield _rows(rows)
    return run


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of near words of ``words`` (word, n) once.  Words must
    have at least four code points, so that a prefix holds two disjoint grams."""
    held = gram_counts(words)
    schema = "key long, word string, n long, last int"
    a = words.mapInArrow(_keyed(held, False), schema).select("key", F.col("word").alias("a"), F.col("n").alias("na"), F.col("last").alias("la"))
    b = words.mapInArrow(_keyed(held, True), schema).select("key", F.col("word").alias("b"), F.col("n").alias("nb"), F.col("last").alias("lb"))
    earlier = (F.col("la") < F.col("lb")) | ((F.col("la") == F.col("lb")) & (F.col("a") < F.col("b")))
    near = earlier & (F.levenshtein("a", "b", 1) == 1)
    return a.join(b, "key").where(near).select("a", "na", "b", "nb").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the last word that ``links`` (word, form) lead to, by pointer
    doubling: the number of rounds is the logarithm of the longest chain."""
    links = written(links.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(links.join(on, "root", "left"))
        links = step.select("word", F.coalesce("next", "root").alias("root"))
        if step.where("next is not null").isEmpty():
            return links


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT,
             factor: int = FACTOR, every: int | None = ALTERED) -> DataFrame:
    """One row per word: word, form (its near word of largest n, if that is at least
    ``factor`` times its own), root, n, n_near, form_n."""
    if min_length < 4:
        raise ValueError("two disjoint grams of three need words of four letters at least")
    if factor < 2:
        raise ValueError("forms must be more frequent than their words")
    words = written(count_words(docs, id_col, text_col, min_length, min_count, every))
    pairs = near_words(words)
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.struct((-F.col("nb")).alias("less"), F.col("b").alias("form")).alias("other")),
                              F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.struct((-F.col("na")).alias("less"), F.col("a").alias("form")).alias("other"))))
    # the smallest of (-n, word) is the most frequent, first in code-point order among equals
    near = written(pairs.select(sides.alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.first("n").alias("n"), F.min("other").alias("best")))
    chosen = -F.col("best.less") >= factor * F.col("n")
    near = near.select("word", "n_near", F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"))
    ends = roots(near.where("form is not null"))
    return (words.join(near, "word", "left").join(ends, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
