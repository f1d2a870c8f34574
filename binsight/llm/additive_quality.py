"""Quality classifier: a generalised additive model with pairwise interactions.

Features of the text only (``FEATURES``) are binned; shallow trees, boosted
cyclically one feature after the other, add up to one lookup table per feature.
The pairs whose joint table explains most of what is left get tables of their
own, boosted in the same way.  A score is the sum of one bin of every table
through the logistic function, looked up for whole batches at once.

The tables learn from a bounded sample (``per_label`` documents of each label on
average, default 4,000) of the labelled rows outside the held-out part; labels,
language, source and id are never features.

Defined results: null and empty texts have all features 0 and are scored like
any other text.  Labels other than 0 and 1 and null labels are ignored, repeated
ones count once.  Without labels, or with one kind only, every score is the
share of good labels (0.5 without any).  Repeated rows get equal results; null
ids are kept and never held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import held_out, labelled_sample, ship

#: byte classes: other, lower, upper, digit, blank, line feed, sentence marks, shouting marks, other ASCII marks, beyond ASCII
_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" \t\r\x0b\x0c", b"\n", b".,;:'\"()-", b"!?", b"#$%&*+/<=>@[\\]^_`{|}~", range(128, 256)), 1):
    _CLASS[list(_chars)] = _i
_CLASSES = 10
#: score from which a document is predicted good
THRESHOLD = 0.7
FEATURES = ("log_bytes", "lower", "upper", "digits", "blanks", "line_feeds", "sentence_marks", "shouting_marks", "other_marks", "beyond_ascii",
            "word_length", "distinct_words", "repeated_neighbours", "most_frequent_word", "repeated_lines", "marked_words")
_CHUNK = 4 << 20


def _word_features(body: bytes) -> list[float]:
    words = body.split()
    n = len(words)
    if not n:
        return [0.0] * 6
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in body.split(b"\n") if x]
    again = sum(map(bytes.__eq__, words, words[1:]))
    bare = sum(1 for w in counts if not w[:1].isalnum() and w[:1] < b"\x80")
    return [sum(map(len, words)) / n, len(counts) / n ** 0.9, again / n, max(counts.values()) / n, 1 - len(set(lines)) / len(lines), bare / len(counts)]


def features(bodies: list[bytes]) -> np.ndarray:
    """(documents, features)."""
    size = np.array([len(b) for b in bodies], dtype=np.int64)
    flat = _CLASS[np.frombuffer(b"".join(bodies), dtype=np.uint8)]
    flat += np.repeat(np.arange(len(bodies)) * _CLASSES, size)
    share = np.bincount(flat, minlength=len(bodies) * _CLASSES).reshape(len(bodies), _CLASSES) / np.maximum(size, 1)[:, None]
    return np.column_stack([np.log1p(size), share[:, 1:], np.array([_word_features(b) for b in bodies]).reshape(len(bodies), 6)])


@dataclass
class Model:
    edges: list[np.ndarray]                 # of each feature's bins
    base: float
    single: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    joint: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for f, t in enumerate(self.single):
            total += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.joint, strict=True):
            total += t[b[:, f], b[:, g]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _leaves(grad: np.ndarray, hess: np.ndarray, leaves: int, penalty: float) -> np.ndarray:
    """Values per bin of the tree that splits the bins greedily into ``leaves`` ranges."""
    g, h = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    cuts = [0, len(grad)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b - a < 2:
                continue
            m = np.arange(a + 1, b)
            gl, hl, gr, hr = g[m] - g[a], h[m] - h[a], g[b] - g[m], h[b] - h[m]
            gain = gl * gl / (hl + penalty) + gr * gr / (hr + penalty) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + penalty)
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), int(m[i]))
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(grad))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + penalty)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that cuts both features of a joint table once."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gain = np.zeros((grad.shape[0] - 1, grad.shape[1] - 1)) if min(grad.shape) > 1 else np.zeros((0, 0))
    if not gain.size:
        return 0.0, np.zeros(grad.shape)
    value = []
    for part in ("ll", "lh", "hl", "hh"):
        def quarter(t, part=part):
            inner = t[1:-1, 1:-1]
            left, top, whole = t[1:-1, -1:], t[-1:, 1:-1], t[-1, -1]
            return {"ll": inner, "lh": left - inner, "hl": top - inner, "hh": whole - left - top + inner}[part]
        gq, hq = quarter(g), quarter(h)
        gain = gain + gq * gq / (hq + penalty)
        value.append(gq / (hq + penalty))
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty(grad.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = (v[i, j] for v in value)
    return float(gain[i, j]), out


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.15, leaves: int = 4, n_pairs: int = 8, pair_rounds: int = 60, penalty: float = 1.0) -> Model:
    n_features = len(FEATURES)
    share = float(y.mean()) if len(y) else 0.5
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(n_features)]
    single = [np.zeros(len(e) + 1) for e in edges]
    if not 0 < share < 1:
        return Model(edges, np.log((share + 1e-6) / (1 - share + 1e-6)) if len(y) else 0.0, single)
    model = Model(edges, float(np.log(share / (1 - share))), single)
    b = model.bins(x)
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(n_features):
            grad, hess = slopes()
            k = len(single[f])
            step = rate * _leaves(np.bincount(b[:, f], grad, k), np.bincount(b[:, f], hess, k), leaves, penalty)
            single[f] += step
            total += step[b[:, f]]
    grad, hess = slopes()

    def table(f, g, weight):
        shape = (len(single[f]), len(single[g]))
        return np.bincount(b[:, f] * shape[1] + b[:, g], weight, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((_quadrants(table(f, g, grad), table(f, g, hess), penalty)[0], f, g) for f in range(n_features) for g in range(f)), reverse=True)
    model.pairs = [(f, g) for gain, f, g in ranked[:n_pairs] if gain > 0]
    model.joint = [np.zeros((len(single[f]), len(single[g]))) for f, g in model.pairs]
    for _ in range(pair_rounds):
        for i, (f, g) in enumerate(model.pairs):
            grad, hess = slopes()
            step = rate * _quadrants(table(f, g, grad), table(f, g, hess), penalty)[1]
            model.joint[i] += step
            total += step[b[:, f], b[:, g]]
    return model


def _batched(bodies: list[bytes]) -> Iterator[list[bytes]]:
    own, size = [], 0
    for b in bodies:
        if own and size + len(b) > _CHUNK:
            yield own
            own, size = [], 0
        own.append(b)
        size += len(b)
    if own:
        yield own


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", per_label: int = 4000) -> Model:
    ship(docs.sparkSession)
    ids = labelled_sample(labels.where(F.col(label_col).isin(0, 1)), label_id, label_col, per_label)

    def vectors(batches):
        for b in batches:
            if b.num_rows:
                x = np.concatenate([features(part) for part in _batched([v.as_py() or b"" for v in b.column("body")])])
                yield pa.RecordBatch.from_arrays([b.column("label"), *(pa.array(x[:, f]) for f in range(x.shape[1]))], names=["label", *FEATURES])

    # broadcast: at most per_label ids for each of two labels
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"))
            .join(F.broadcast(ids.select("id", F.col("label").cast("int").alias("label"))), "id").select("label", "body")
            .mapInArrow(vectors, "label int, " + ", ".join(f"{f} double" for f in FEATURES)).toPandas())
    rows = rows.sort_values(list(rows.columns))                # a fixed order of the sample, however its tasks ended
    return fit(rows[list(FEATURES)].to_numpy(dtype=float), rows["label"].to_numpy(dtype=float))


def scorer(model: Model, text_col: str | Column) -> Column:
    """Score (0 to 1) of a text column."""
    @F.arrow_udf("double")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            bodies = [(t or "").encode("utf-8", "replace") for t in part.to_pylist()]
            yield pa.array(np.concatenate([model.scores(features(own)) for own in _batched(bodies)]) if bodies else np.zeros(0))

    return run(F.col(text_col).cast("string") if isinstance(text_col, str) else text_col)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, per_label: int = 4000) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_col, text_col, per_label=per_label)
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), scorer(model, text_col).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
