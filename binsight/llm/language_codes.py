"""Language identification with error-correcting output codes.

Every language gets a codeword; one binary classifier per bit (logistic
regression on hashed byte n-grams of the lower-cased text) says which half of
the languages a text belongs to.  Decoding adds, for every language, the
logistic losses of the bits against its codeword, weighted by how well the bit
did in training, and takes the nearest codeword.  A text is flagged ambiguous
when the second codeword is nearly as close.

The classifiers learn from a bounded sample (``per_language`` documents of each
language on average, default 600) of the rows outside the held-out part; only
text and language are used, and the sample's vectors are all that reaches the driver.

Defined results: null texts and texts without a letter are ``und`` with score 0
and ambiguous; so is everything if no language was learned.  With one language
every text with a letter gets it.  Repeated rows get equal results; null ids are
kept and never held out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binsight.llm.common import hashed_vectors, held_out, labelled_sample, ship

N_GRAM, BUCKETS = 3, 1024
UNKNOWN = "und"
#: a letter: Unicode category L (digits in circles, fractions and the like are none)
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 4 << 20


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """(n, bits) of -1 / +1: the exhaustive code up to 7 classes, beyond that the
    random code with the largest smallest distance of 200 draws."""
    if n == 0:
        return np.zeros((0, 0))
    if n <= 7:
        bits = [[1 if (c >> i) & 1 == 0 else -1 for i in range(n)] for c in range(1, 1 << max(n - 1, 0))]
        return np.array(bits, dtype=np.float64).T.reshape(n, -1)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, 10 * math.ceil(math.log2(n))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        apart = (code.shape[1] - code @ code.T) / 2 + np.eye(n) * code.shape[1]
        if apart.min() > far:
            best, far = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray          # (buckets, bits)
    bias: np.ndarray
    bit_weight: np.ndarray
    ambiguous_below: float


def fit(x: np.ndarray, languages: list[str], rounds: int = 150, decay: float = 1e-5, ambiguous_below: float = 0.05) -> Model:
    names = sorted(set(languages))
    code = codewords(len(names))
    index = {l: i for i, l in enumerate(names)}
    own = np.array([index[l] for l in languages], dtype=np.int64)
    target = code[own] if len(own) else np.zeros((0, code.shape[1]))
    share = 1 / np.bincount(own, minlength=len(names))[own] if len(own) else np.zeros(0)
    share = (share / share.sum())[:, None] if len(own) else share[:, None]
    w, b = np.zeros((x.shape[1], code.shape[1])), np.zeros(code.shape[1])
    step, vw, vb = 40.0, np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds if code.shape[1] and len(own) else 0):
        pull = share * target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        vw = 0.9 * vw + x.T @ pull - decay * w
        vb = 0.9 * vb + pull.sum(axis=0)
        w += step * vw
        b += step * vb
    right = (share * (target * (x @ w + b) > 0)).sum(axis=0) if len(own) else np.ones(code.shape[1])
    return Model(names, code, w, b, np.maximum(2 * right - 1, 0.01), ambiguous_below)


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the nearest codeword, its share against the others, ambiguity."""
    margins = x @ model.weights + model.bias
    loss = np.stack([(np.logaddexp(0, -row * margins) * model.bit_weight).sum(axis=1) for row in model.code], axis=1)
    loss = loss / max(model.bit_weight.sum(), 1e-9)
    odds = np.exp(-4 * (loss - loss.min(axis=1, keepdims=True)))
    order = np.sort(loss, axis=1)
    gap = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return loss.argmin(axis=1), odds.max(axis=1) / odds.sum(axis=1), gap < model.ambiguous_below


def features(bodies: list[bytes]) -> np.ndarray:
    return hashed_vectors([b.lower() for b in bodies], N_GRAM, BUCKETS)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> Model:
    ship(docs.sparkSession)
    ids = labelled_sample(docs, id_col, lang_col, per_language)

    def vectors(batches):
        for b in batches:
            if b.num_rows:
                bodies = [x.as_py() for x in b.column("body")]
                x = np.concatenate([features(bodies[i:i + 64]) for i in range(0, len(bodies), 64)])
                yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([v.astype(np.float32).tobytes() for v in x], pa.binary())], names=["label", "x"])

    # broadcast: at most per_language ids and labels for each language
    rows = (docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").cast("binary").alias("body"))
            .where("body is not null and label is not null").join(F.broadcast(ids.select("id")), "id", "left_semi")
            .select("label", "body").mapInArrow(vectors, "label string, x binary").toArrow())
    x = np.stack([np.frombuffer(v, np.float32) for v in rows.column("x").to_pylist()]).astype(np.float64) if len(rows) else np.zeros((0, BUCKETS))
    order = np.lexsort(x[:, :4].T) if len(x) else np.zeros(0, int)      # a fixed order of the sample, however its tasks ended
    return fit(x[order], [rows.column("label")[int(i)].as_py() for i in order])


def predictor(model: Model, text_col: str | Column) -> Column:
    """struct<lang_pred, score, ambiguous> of a text column."""
    @F.arrow_udf("struct<lang_pred:string,score:double,ambiguous:boolean>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            texts = part.to_pylist()
            lang, score, unsure = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            known = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model.languages else []
            at = 0
            while at < len(known):
                own, size = [], 0
                while at < len(known) and (not own or size < _CHUNK) and len(own) < 1024:
                    own.append(known[at])
                    size += len(texts[known[at]])
                    at += 1
                best, share, vague = decode(model, features([texts[i].encode("utf-8", "replace") for i in own]))
                score[own], unsure[own] = share, vague
                for i, k in zip(own, best, strict=True):
                    lang[i] = model.languages[k]
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=["lang_pred", "score", "ambiguous"])

    return run(F.col(text_col).cast("string") if isinstance(text_col, str) else text_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 600) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, ambiguous."""
    model = train(docs, id_col, text_col, lang_col, per_language)
    return (docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), predictor(model, text_col).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score", "p.ambiguous"))
