"""Fuzzy search for short licence notices.

A notice of ``errors`` allowed edits is split into ``errors + 1`` pieces; at most
``errors`` edits leave one piece intact, so exact occurrences of the pieces lead to
every candidate place.  There the ``regex`` library's bounded-error matching
verifies the whole notice, and the span is reported in words with its number of
edits.  Notices without errors are their own single piece and have to stand on
word borders.

Texts are lower-cased (A-Z), cut into words and joined by single blanks, so line
breaks and punctuation inside a notice don't matter.

Defined results: null and empty texts have no words, no spans, empty labels and
score 0.  Repeated rows get equal results; null ids are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from binsight.llm.common import as_bytes, ship, slices
from binsight.llm.phrase_index import words_of


@dataclass(frozen=True)
class Notice:
    label: str
    words: str               # lower case, single blanks
    errors: int = 0          # edits (letters put in, left out or changed)
    base: bool = False


#: exact phrases whose places are counted
BASE = (Notice("cc-by", "cc by", base=True), Notice("gpl", "general public license", base=True), Notice("reserved", "all rights reserved", base=True))
#: opening words of common notices, found with small errors
FUZZY = (
    Notice("apache-notice", "licensed under the apache license", 3),
    Notice("bsd-notice", "redistribution and use in source and binary forms", 4),
    Notice("cc-notice", "licensed under a creative commons attribution", 4),
    Notice("cc-nc-notice", "licensed under cc by nc", 2),
    Notice("gpl-notice", "licensed under the gnu general public license", 4),
    Notice("gpl-program-notice", "this program is free software you can redistribute it", 5),
    Notice("mit-notice", "released under the mit license", 2),
    Notice("mit-text", "permission is hereby granted free of charge", 4),
    Notice("mpl-notice", "subject to the terms of the mozilla public license", 4),
    Notice("reserved-notice", "all rights reserved", 2),
)


class _Search:
    def __init__(self, notice: Notice):
        self.notice = notice
        self.text = f" {notice.words} ".encode() if notice.errors == 0 else notice.words.encode()
        n, k = len(self.text), notice.errors
        cuts = [n * i // (k + 1) for i in range(k + 2)]
        self.seeds = [(a, self.text[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        self.pattern = regex.compile(b"(?:" + regex.escape(self.text) + (b"){e<=%d}" % k if k else b")"), regex.ENHANCEMATCH if k else 0)

    def spans(self, body: bytes):
        """(first, past the last byte, edits) of the notice in a normalised text."""
        k, n = self.notice.errors, len(self.text)
        regions = []
        for offset, seed in self.seeds:
            at = body.find(seed)
            while at >= 0:
                regions.append((max(0, at - offset - k), min(len(body), at - offset + n + k)))
                at = body.find(seed, at + 1)
        regions.sort()
        merged = []
        for a, b in regions:
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        for a, b in merged:
            # overlapping: phrases that share a blank or a word are places of their own
            for m in self.pattern.finditer(body, a, b, overlapped=k == 0):
                yield m.start(), m.end(), sum(m.fuzzy_counts)


_SEARCHES: dict[tuple, list[_Search]] = {}


def notice_spans(body: bytes, searches: list[_Search]) -> tuple[int, list[tuple]]:
    """Number of words, and (notice, first word, last word, edits) of every match."""
    words = words_of(body)
    text = b" " + b" ".join(words) + b" "
    found = []
    blanks = None           # places of the blanks, for the first match on
    for s in searches:
        for a, b, edits in s.spans(text):
            if blanks is None:
                blanks = np.flatnonzero(np.frombuffer(text, dtype=np.uint8) == 32)
            while a < b and text[a] == 32:
                a += 1
            while b > a and text[b - 1] == 32:
                b -= 1
            first = int(np.searchsorted(blanks, a)) - 1
            found.append((s.notice, first, int(np.searchsorted(blanks, b)) - 1, edits))
    return len(words), found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: tuple[Notice, ...] = BASE + FUZZY) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score, spans (array of label, first, last, edits)."""
    ship(docs.sparkSession)
    kind = "array<struct<label:string,first:bigint,last:bigint,edits:int>>"

    def run(batches):
        if notices not in _SEARCHES:
            _SEARCHES[notices] = [_Search(n) for n in notices]
        searches = _SEARCHES[notices]
        for batch in slices(batches, 4 << 20):
            rows = []
            for body in batch.column("body"):
                n, found = notice_spans(body.as_py(), searches)
                base = [f for f in found if f[0].base]
                rows.append({
                    "n_words": n, "n_base": len(base), "first_word": min((f[1] for f in base), default=None), "last_word": max((f[1] for f in base), default=None),
                    "base_labels": ",".join(sorted({f[0].label for f in base})), "labels": ",".join(sorted({f[0].label for f in found})),
                    "score": max((1 - f[3] / len(f[0].words) for f in found), default=0.0),
                    "spans": [{"label": f[0].label, "first": f[1], "last": f[2], "edits": f[3]} for f in sorted(found, key=lambda f: (f[1], f[2], f[0].label))]})
            out = pa.Table.from_pylist(rows, schema=pa.schema([
                ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()),
                ("labels", pa.string()), ("score", pa.float64()),
                ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("edits", pa.int32())])))]))
            yield from out.add_column(0, "doc_id", batch.column("doc_id")).combine_chunks().to_batches()

    return as_bytes(docs, id_col, text_col).mapInArrow(
        run, f"doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {kind}")
