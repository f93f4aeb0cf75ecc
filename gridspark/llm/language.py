"""Language identification: averaged hashed subword embeddings under a linear softmax, trained by SGD in numpy.

Subwords are the runs of one to three bytes of the lower-cased text in which everything but letters is one blank. A text
is the mean of its subwords' embeddings. As softmax and mean are linear in the embeddings, scoring sums one row of
``embedding @ weights`` for each subword. A temperature and a rejection bound are fitted to rows that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm import sampling
from gridspark.llm.text import Piece, pieces

#: Documents that the embeddings are trained on, at most.
TRAINING_ROWS = 2_000
BUCKETS = 1 << 13
DIMENSIONS = 16
ORDERS = (1, 2, 3)
UNDETERMINED = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True
_ASCII_LETTER = np.zeros(256, dtype=bool)
_ASCII_LETTER[97:123] = True


@dataclass
class Languages:
    names: list[str]
    table: np.ndarray  # one row of contributions to the softmax for each bucket
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0


def _subwords(piece: Piece) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bucket and text of every subword, one order after the other."""
    mapped = np.where(_LETTER[piece.lower], piece.lower, np.uint8(32)).astype(np.uint32)
    owner = np.repeat(np.arange(piece.n), np.diff(piece.offsets))
    code = np.zeros(len(mapped), dtype=np.uint32)
    letters = np.zeros(len(mapped), dtype=bool)
    for order in range(1, max(ORDERS) + 1):
        count = len(mapped) - order + 1
        if count <= 0:
            return
        code = code[:count] * np.uint32(257) + mapped[order - 1 :]
        letters = letters[:count] | (mapped[order - 1 :] != 32)
        if order in ORDERS:
            at = np.flatnonzero(letters & (owner[:count] == owner[order - 1 :]))
            hashed = (code[at] + np.uint32(order)) * np.uint32(2654435761)
            yield (hashed >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64), owner[at]


def _has_letter(piece: Piece, i: int) -> bool:
    own = piece.lower[piece.offsets[i] : piece.offsets[i + 1]]
    if _ASCII_LETTER[own].any():
        return True
    # letters beyond ASCII: Unicode category L, so neither fractions nor superscripts
    return bool((own >= 128).any() and any(map(str.isalpha, own.tobytes().decode("utf-8", "replace"))))


def bags(texts: pa.Array) -> pa.Array:
    """Share of every bucket among the subwords of a text, as float32 bytes; null without a letter."""
    out: list[bytes | None] = []
    for piece in pieces(texts):
        found = list(_subwords(piece))
        for i in range(piece.n):
            bag = np.zeros(BUCKETS)
            for bucket, owner in found:
                a, b = np.searchsorted(owner, [i, i + 1])
                bag += np.bincount(bucket[a:b], minlength=BUCKETS)
            out.append((bag / bag.sum()).astype(np.float32).tobytes() if _has_letter(piece, i) and bag.sum() else None)
    return pa.array(out, type=pa.binary())


def fit(x: np.ndarray, y: np.ndarray, classes: int, steps: int = 400, batch: int = 128, rate: float = 0.1) -> tuple:
    """Embeddings, softmax weights and bias by minibatch SGD with a fixed seed and AdaGrad steps."""
    random = np.random.default_rng(7)
    embedding = random.normal(0, 0.1, (x.shape[1], DIMENSIONS))
    weights, bias = random.normal(0, 0.3, (DIMENSIONS, classes)), np.zeros(classes)
    layers = [embedding, weights, bias]
    seen = [np.full_like(layer, 1e-8) for layer in layers]
    scale = 10.0  # shares are small
    for _ in range(steps if len(y) else 0):
        rows = random.integers(0, len(y), min(batch, len(y)))
        own = x[rows] * scale
        hidden = own @ embedding
        p = _probabilities(hidden @ weights + bias)
        p[np.arange(len(rows)), y[rows]] -= 1
        p /= len(rows)
        for layer, total, gradient in zip(layers, seen, (own.T @ (p @ weights.T), hidden.T @ p, p.sum(axis=0)), strict=True):
            total += gradient**2
            layer -= rate * gradient / np.sqrt(total)
    return embedding * scale, weights, bias


def _probabilities(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(documents: DataFrame, rows: int = TRAINING_ROWS, precision: float = 0.95) -> Languages:
    """Learn ``lang`` from at most ``rows`` documents outside the held-out fold that have a language and a text.

    A fifth of them is left out of training: on it the temperature minimises the log loss, and the rejection bound is
    the least score from which ``precision`` of the predictions are right.
    """
    usable = documents.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~sampling.held_out(F.col("doc_id"))
    )
    keys = sampling.bounded(usable.select(F.col("doc_id").alias("key")).distinct(), rows, "key")
    bag = F.arrow_udf(bags, "binary")
    # bounded by `rows`; of rows with one id one is taken
    sampled = usable.join(F.broadcast(keys), usable["doc_id"] == keys["key"])
    once = sampled.groupBy("key").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("row"))
    table = once.select("key", "row.lang", bag("row.text").alias("bag")).toArrow()
    found = sorted(r for r in zip(*(table[c].to_pylist() for c in ("key", "lang", "bag")), strict=True) if r[2] is not None)
    names = sorted({r[1] for r in found})
    if not found:
        return Languages([], np.zeros((BUCKETS, 0)), np.zeros(0))
    x = np.frombuffer(b"".join(r[2] for r in found), dtype=np.float32).reshape(len(found), BUCKETS)
    y = np.array([names.index(r[1]) for r in found])
    fold = np.arange(len(y)) % 5 == 4
    embedding, weights, bias = fit(x[~fold], y[~fold], len(names))
    model = Languages(names, embedding @ weights, bias)
    if fold.any():
        logits, truth = x[fold] @ model.table + bias, y[fold]
        own = np.arange(len(truth))
        grid = np.geomspace(0.25, 8, 41)
        model.temperature = float(min(grid, key=lambda t: -np.log(_probabilities(logits / t)[own, truth] + 1e-12).sum()))
        p = _probabilities(logits / model.temperature)
        right, top = p.argmax(axis=1) == truth, p.max(axis=1)
        order = np.argsort(-top, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) >= precision * np.arange(1, len(order) + 1))
        model.least = float(top[order][good[-1]]) if len(good) else 1.0
    return model


def identify(model: Languages, text: Column | str = "text") -> Column:
    """Struct of ``lang``, ``score`` and ``accepted``.

    ``lang`` is a learned language, or ``und`` with score 0 if the text is null or holds no letter (or nothing was
    learned). ``accepted`` says whether the score reaches the calibrated rejection bound.
    """

    @F.arrow_udf("struct<lang:string,score:double,accepted:boolean>")
    def identified(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            lang, score = [], []
            for piece in pieces(texts):
                total = np.zeros((piece.n, len(model.names)))
                count = np.zeros(piece.n)
                for bucket, owner in _subwords(piece):
                    count += np.bincount(owner, minlength=piece.n)
                    for k in range(len(model.names)):
                        total[:, k] += np.bincount(owner, model.table[bucket, k], piece.n)
                known = [bool(model.names) and count[i] > 0 and _has_letter(piece, i) for i in range(piece.n)]
                if not model.names:
                    lang += [UNDETERMINED] * piece.n
                    score += [0.0] * piece.n
                    continue
                p = _probabilities((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                best = p.argmax(axis=1)
                lang += [model.names[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                score += [float(s) if k else 0.0 for s, k in zip(p.max(axis=1), known, strict=True)]
            accepted = [name != UNDETERMINED and s >= model.least for name, s in zip(lang, score, strict=True)]
            yield pa.StructArray.from_arrays(
                [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(accepted, pa.bool_())],
                names=["lang", "score", "accepted"],
            )

    return identified(text)


def languages(documents: DataFrame, model: Languages) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred``, ``score`` and ``accepted`` for every row."""
    found = documents.select("doc_id", identify(model).alias("found"))
    return found.select(
        "doc_id",
        sampling.held_out(F.col("doc_id")).alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.accepted").alias("accepted"),
    )
