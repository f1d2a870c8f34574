"""Packing along a space-filling curve.

A document becomes a hashed vector of byte n-gram counts, is projected to a few
dimensions and gets the Hilbert index of its cell.  Documents are range-sorted
by that index, concatenated in this order and cut into sequences, so that
neighbours along the curve share sequences.

One shuffle moves each text once.  A row's position is its Hilbert key followed by
the first bits of a tie-break hash, so thousands of copies with one key still spread
over ranges.  The projected points of all rows are stored; centre and scale are their
means and deviations, and the range bounds come from the bytes of all rows per
position prefix (``bounds_of``).  Within a range, whole sequences of ``length`` tokens
are filled without gaps; the rest of a range (under ``length`` tokens) is cut into
sequences whose lengths are powers of two, so nothing is padded at all.

Token ids are those of the ``tokenizers`` file.  Texts of plain Latin characters
are encoded with the same vocabulary as byte ranks (several times faster, same
ids, tested); all other texts, and those with a run of over 100,000 white-space
characters, which the faster library's pattern cannot match at any length, go
through the ``tokenizers`` library itself.

Defined results: a null or empty text is one separator token.  Every row is a
document of its own, also when ids repeat or are null.  Texts of any length are
cut into as many pieces as needed.  An empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import hashed_vectors, ship, slices, written

BUCKETS, DIMS, BITS = 256, 4, 12
#: bits of the tie-break hash in a position, and of a position (never negative as a long)
TIE_BITS = 15
POSITION_BITS = DIMS * BITS + TIE_BITS
#: bits by which a heavy position prefix grows at a time
STEP = 4
_SEED = 7


# ------------------------------------------------------------ vectors and keys

def projected(bodies: list[bytes]) -> np.ndarray:
    return hashed_vectors(bodies, 4, BUCKETS) @ np.random.default_rng(_SEED).standard_normal((BUCKETS, DIMS))


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert curve index of integer points (rows of ``cells``, values below
    ``2**bits``), by undoing excess rotations from the highest bit down and Gray
    decoding the transposed bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve_keys(points: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Hilbert keys of projected vectors; a logistic curve spreads each dimension over its cells."""
    z = np.clip((points - centre) / scale, -30, 30)
    return hilbert_index(np.minimum(((1 << BITS) / (1 + np.exp(-1.7 * z))).astype(np.int64), (1 << BITS) - 1))


def positions(key: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Places of rows in the order they are packed in."""
    return (key << TIE_BITS) | (tie.astype(np.uint64) >> np.uint64(64 - TIE_BITS)).astype(np.int64)


def bounds_of(placed: DataFrame, n_ranges: int) -> list[int]:
    """First positions of the second and later ranges of ``placed`` (pos, weight), all
    rows counted.  Weights are summed by position prefix; a prefix of over a quarter
    of a range is cut finer until none is left or the position ends, so no step brings
    more than 64 sums per range to the driver."""
    bits = min(POSITION_BITS, max(8, (16 * n_ranges).bit_length()))
    leaves, rows, limit, total = [], placed, None, 0
    while True:
        shift = POSITION_BITS - bits
        sums = [(r.cell << shift, r.w) for r in rows.groupBy(F.shiftright("pos", shift).alias("cell")).agg(F.sum("weight").alias("w")).collect()]
        if limit is None:
            total = sum(w for _, w in sums)
            limit = total / (4 * n_ranges)
        heavy = [(p,) for p, w in sums if w > limit and shift]
        leaves += [(p, w) for p, w in sums if not (w > limit and shift)]
        if not heavy:
            break
        cells = placed.sparkSession.createDataFrame(heavy, "cell long")
        rows = placed.join(cells, F.shiftleft(F.shiftright("pos", shift), shift) == F.col("cell"), "left_semi")
        bits = min(POSITION_BITS, bits + STEP)
    leaves.sort()
    end = np.cumsum([w for _, w in leaves])
    at = np.searchsorted(end, total * np.arange(1, n_ranges) / n_ranges) + 1
    return sorted({leaves[i][0] for i in at if i < len(leaves)})


# ------------------------------------------------------------ token ids

#: printable ASCII, tab, line feed, carriage return and Latin letters: here both libraries share every character class
_PLAIN = re.compile("[^\t\n\r -~À-ÖØ-öø-ſ]")
#: white space of which the faster library's regex engine runs out of stack at about ten times this length
_LONG_BLANK = re.compile(r"(?<![\t\n\r ])[\t\n\r ]{100001}")


class Ids:
    """Token ids of texts as ``uint32`` arrays."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer, decoders
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        # byte of each character of the byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items()
                 if all(c in byte_of for c in token)}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {k: v for k, v in ranks.items() if v not in added.values()}
        assert isinstance(self.library.decoder, decoders.ByteLevel)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
        self.added = set(added)

    def __call__(self, text: str) -> np.ndarray:
        if _PLAIN.search(text) is None and (len(text) <= 100_000 or _LONG_BLANK.search(text) is None):
            return self.fast.encode_to_numpy(text, allowed_special=self.added, disallowed_special=())
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_IDS: dict[str, Ids] = {}


def ids_of(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


# ------------------------------------------------------------ packing

class Packer:
    """Fills sequences in order; pieces of the unfinished one wait for its end."""

    def __init__(self, length: int):
        self.length, self.used, self.open, self.rows, self.sequence = length, 0, [], [], 0

    def add(self, doc, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            n = min(self.length - self.used, total - at)
            self.open.append((doc, at, ids[at:at + n], total))
            self.used += n
            at += n
            if self.used == self.length:
                self._close([self.length])

    def _close(self, lengths: list[int]) -> None:
        room, offset = iter(lengths), 0
        left = next(room)
        for doc, start, ids, total in self.open:
            while len(ids):
                n = min(left, len(ids))
                self.rows.append((doc, start, n, zlib.crc32(ids[:n].astype("<u4").tobytes()), total, self.sequence, offset))
                start, ids, offset, left = start + n, ids[n:], offset + n, left - n
                if left == 0:
                    self.sequence, offset, left = self.sequence + 1, 0, next(room, 0)
        self.open, self.used = [], 0

    def finish(self) -> None:
        """The rest, in sequences whose lengths are the powers of two that make it up."""
        self._close([1 << b for b in range(self.used.bit_length() - 1, -1, -1) if self.used >> b & 1] or [0])

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 1024, separator: int = 0,
         ranges: int | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``length`` tokens: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    ship(spark)
    n_ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text).alias("tie"), text.cast("binary").alias("body"))

    def points(batches):
        for batch in slices(batches, 2 << 20):
            p = projected([b.as_py() for b in batch.column("body")])
            size = pc.binary_length(batch.column("body"))
            yield pa.RecordBatch.from_arrays([batch.column("tie"), size.cast(pa.int64()), *(pa.array(p[:, i]) for i in range(DIMS))],
                                             names=["tie", "size", *(f"x{i}" for i in range(DIMS))])

    axes = [f"x{i}" for i in range(DIMS)]
    stored = written(rows.mapInArrow(points, "tie long, size long, " + ", ".join(f"{x} double" for x in axes)))
    found = stored.agg(*(F.avg(x) for x in axes), *(F.stddev_pop(x) for x in axes)).first()
    centre = np.array([v or 0.0 for v in found[:DIMS]])
    scale = np.maximum([v or 0.0 for v in found[DIMS:]], 1e-9)

    def weigh(batches):
        for batch in batches:
            key = curve_keys(np.stack([batch.column(x).to_numpy() for x in axes], axis=1), centre, scale)
            yield pa.RecordBatch.from_arrays([pa.array(positions(key, batch.column("tie").to_numpy())), pa.array(batch.column("size").to_numpy() + 500)],
                                             names=["pos", "weight"])

    bounds = np.array(bounds_of(written(stored.mapInArrow(weigh, "pos long, weight long")), n_ranges), dtype=np.int64)

    def place(batches):
        for batch in slices(batches, 2 << 20):
            key = curve_keys(projected([b.as_py() for b in batch.column("body")]), centre, scale)
            rid = np.searchsorted(bounds, positions(key, batch.column("tie").to_numpy()), "right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tie"), batch.column("body"), pa.array(key), pa.array(rid)],
                                             names=["doc_id", "tie", "body", "key", "rid"])

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def fill(batches):
        encode, packer, own = ids_of(path), Packer(length), None
        end = np.array([separator], dtype=np.uint32)

        def out(rid):
            made = packer.taken()
            cols = list(zip(*made, strict=True)) if made else [[]] * 7
            arrays = [pa.array(c, pa.int64()) for c in cols]
            arrays[5] = pa.array(np.array(cols[5], dtype=np.int64) + (np.int64(rid) << np.int64(40)))
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in slices(batches, 4 << 20):
            for doc, rid, body in zip(batch.column("doc_id").to_pylist(), batch.column("rid").to_pylist(), batch.column("body"), strict=True):
                if own is not None and rid != own:
                    packer.finish()
                    yield out(own)
                own = rid
                packer.add(doc, np.concatenate([encode(body.as_py().decode("utf-8", "replace")), end]))
            if packer.rows:
                yield out(own)
        if own is not None:
            packer.finish()
            yield out(own)

    placed = rows.mapInArrow(place, "doc_id long, tie long, body binary, key long, rid int")
    return (placed.repartitionById(len(bounds) + 1, "rid").sortWithinPartitions("rid", "key", "tie", "doc_id")
            .select("doc_id", "rid", "body").mapInArrow(fill, ", ".join(f"{c} long" for c in names)))
