"""Token counts by rank-synchronous array merging.

Pre-tokens are held as one ragged array of symbol numbers.  In every step each
sequence looks up the ranks of its neighbouring pairs and applies its
lowest-ranked pair at all its places at once; sequences without a mergeable
pair are done, and a sequence's count is the number of surviving symbols.

The normaliser, the splitting pattern, the vocabulary, the merges and the added
tokens come from the ``tokenizers`` file.  Texts are cut at white space, and the
count of a cut piece is remembered (up to ``REMEMBERED`` pieces of
``REMEMBERED_CHARS`` characters in all), so merging runs over
batches of pieces not seen before.  A step merges one rank per sequence, so a
single pre-token of over ``LONGEST`` symbols would take a step for nearly every
rank it holds; such a run of letters without any break is given to the
library's model, whose queue suits it.

Defined results: null and empty texts have 0 tokens and 0 bytes (an empty text
is within every limit).  Repeated rows get equal results; a null id is kept.
"""

from __future__ import annotations

import json
import re
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import as_bytes, ship, slices

REMEMBERED = 1_000_000
#: and characters of them: without blanks (Chinese, base64) a chunk is a whole line
REMEMBERED_CHARS = 32 << 20
#: symbols of a single pre-token up to which its pairs are merged here
LONGEST = 20_000
_NONE = np.int64(1) << 40


class RankMerger:
    """The merges of a BPE vocabulary as sorted arrays, applied to ragged arrays."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], dtype=np.int64)
        cut = len(self.suffix)
        made = np.array([self.vocab[(a[:-cut] if cut and a.endswith(self.suffix) else a) + b] for a, b in pairs], dtype=np.int64)
        self.width = np.int64(max(self.vocab.values()) + 1)
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

        codes = max(ord(c) for c in self.vocab if len(c) == 1) + 1
        self.inner = np.array([self.vocab.get(chr(c), -1) for c in range(codes)], dtype=np.int64)
        self.last = np.array([self.vocab.get(chr(c) + self.suffix, -1) for c in range(codes)], dtype=np.int64)

    def ragged(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol numbers of byte-mapped, non-empty pieces and the piece of each;
        characters without a symbol are left out."""
        size = np.array([len(p) for p in pieces], dtype=np.int64)
        code = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype=np.uint32)
        flat = self.inner[code]
        end = np.cumsum(size) - 1
        flat[end] = self.last[code[end]]
        owner = np.repeat(np.arange(len(pieces)), size)
        return flat[flat >= 0], owner[flat >= 0]

    def _look(self, left: np.ndarray, right: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (``_NONE`` if it has none) and the symbol it makes."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & same, self.ranks[at], _NONE), self.made[at]

    def counts(self, flat: np.ndarray, owner: np.ndarray, n_pieces: int) -> np.ndarray:
        """Surviving symbols of each piece of a ragged array."""
        result = np.bincount(owner, minlength=n_pieces)
        if len(flat) < 2:
            return result
        rank = np.full(len(flat), _NONE)          # of the pair that starts here
        made = np.zeros(len(flat), dtype=np.int64)
        rank[:-1], made[:-1] = self._look(flat[:-1], flat[1:], owner[:-1] == owner[1:])
        while True:
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            low = np.minimum.reduceat(rank, starts)
            n = np.diff(np.append(starts, len(flat)))
            alive = np.repeat(low < _NONE, n)      # finished sequences leave
            if not alive.any():
                return result
            flat, owner, rank, made, lowest = flat[alive], owner[alive], rank[alive], made[alive], np.repeat(low, n)[alive]
            run = np.flatnonzero(rank == lowest)
            # of overlapping places (a a a) every second one counts, from the left
            first = np.append(True, np.diff(run) > 1)
            head = np.repeat(run[first], np.diff(np.append(np.flatnonzero(first), len(run))))
            run = run[(run - head) % 2 == 0]
            flat[run] = made[run]
            result -= np.bincount(owner[run], minlength=n_pieces)
            keep = np.ones(len(flat), dtype=bool)
            keep[run + 1] = False
            new = (np.cumsum(keep) - 1)[run]       # places of the merged symbols once the rest has closed up
            flat, owner, rank, made = flat[keep], owner[keep], rank[keep], made[keep]
            stale = np.unique(np.concatenate([new, new - 1]))
            stale = stale[stale >= 0]
            rank[stale] = _NONE
            stale = stale[stale < len(flat) - 1]
            rank[stale], made[stale] = self._look(flat[stale], flat[stale + 1], owner[stale] == owner[stale + 1])


class Counter:
    """Counts the tokens of texts as the library's file describes them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.merger = RankMerger(spec["model"])
        library = Tokenizer.from_file(path)
        self.normalize = library.normalizer.normalize_str if library.normalizer else (lambda s: s)
        self.split = library.pre_tokenizer.pre_tokenize_str
        self.model = library.model
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.opening = [a[:2] for a in added]
        self.seen: dict[str, int] = {}
        self.seen_chars = 0

    def learn(self, chunks: list[str]) -> np.ndarray:
        """Counts of chunks without white space, merged in one batch."""
        if not chunks:
            return np.zeros(0, dtype=np.int64)
        joined = self.normalize(" ".join(chunks))
        apart = joined.split(" ")
        if len(apart) != len(chunks):            # a normaliser that makes or drops blanks
            return np.concatenate([self.learn([c]) for c in chunks]) if len(chunks) > 1 else np.array([self._counts([p for p, _ in self.split(joined)]).sum()])
        pieces = self.split(joined)
        ends = np.cumsum([len(c) + 1 for c in apart])
        at = np.searchsorted(ends, [span[0] for _, span in pieces], side="right")
        return np.bincount(at, weights=self._counts([p for p, _ in pieces]), minlength=len(chunks)).astype(np.int64)

    def _counts(self, pieces: list[str]) -> np.ndarray:
        """Surviving symbols of byte-mapped pieces."""
        n = np.zeros(len(pieces), dtype=np.int64)
        short = [i for i, p in enumerate(pieces) if 0 < len(p) <= LONGEST]
        if short:
            n[short] = self.merger.counts(*self.merger.ragged([pieces[i] for i in short]), len(short))
        for i, p in enumerate(pieces):
            if len(p) > LONGEST:
                n[i] = len(self.model.tokenize(p))
        return n

    def batch(self, texts: list[str]) -> np.ndarray:
        out, chunked = np.zeros(len(texts), dtype=np.int64), []
        for i, text in enumerate(texts):
            if self.added is not None and any(o in text for o in self.opening):
                parts = self.added.split(text)
                out[i] += len(parts) - 1
                chunked.append([c for p in parts for c in _chunks(p)])
            else:
                chunked.append(_chunks(text))
        missing = set().union(*chunked).difference(self.seen)
        chars = sum(map(len, missing))
        if len(self.seen) + len(missing) > REMEMBERED or self.seen_chars + chars > REMEMBERED_CHARS:
            self.seen, self.seen_chars = {}, 0
            missing = set().union(*chunked)
            chars = sum(map(len, missing))
        self.seen_chars += chars
        known, missing = self.seen, list(missing)
        for a in range(0, len(missing), 1 << 15):
            part = missing[a:a + (1 << 15)]
            known.update(zip(part, self.learn(part).tolist(), strict=True))
        get = known.__getitem__
        for i, chunks in enumerate(chunked):
            out[i] += sum(map(get, chunks))
        return out


#: separators that Python splits at but the pattern's white space does not contain
_ODD = re.compile("[\x1c-\x1f]")


def _chunks(text: str) -> list[str]:
    """Runs between white space; no token of the pattern crosses white space."""
    if _ODD.search(text):
        return [c for c in re.split(r"[^\S\x1c-\x1f]+", text) if c]
    return text.split()


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter per Python worker and file."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.  ``path``
    must name the vocabulary file on every node."""
    ship(docs.sparkSession)

    def run(batches):
        own = counter(path)
        for batch in slices(batches, 4 << 20):
            bodies = [b.as_py() for b in batch.column("body")]
            n = own.batch([b.decode("utf-8", "replace") for b in bodies])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(b) for b in bodies], pa.int64()), pa.array(n)],
                names=["doc_id", "n_bytes", "n_tokens"])

    counted = as_bytes(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
