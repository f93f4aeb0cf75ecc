"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

The trees are trained on a bounded sample of labelled rows outside the held-out fold and flattened into arrays; scoring
walks all rows of a batch through them at once. Only the text enters a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm import boosting, sampling
from gridspark.llm.text import BLANK_SEPARATED, LINES, Piece, pieces

#: Labelled rows that the trees are trained on, at most.
TRAINING_ROWS = 10_000
#: Scores from here on count as good.
THRESHOLD = 0.3

_CLASSES = ("lower", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "bracket", "lead", "follow", "control")
_CLASS = np.full(256, _CLASSES.index("control"), dtype=np.int64)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": b" \t", "line": b"\n\r",
    "stop": b".,;:'\"", "mark": b"!?", "symbol": b"#$%&*+-/<=>@\\^_`|~", "bracket": b"()[]{}",
    "lead": range(192, 256), "follow": range(128, 192),
}.items():
    _CLASS[list(_bytes)] = _CLASSES.index(_name)
STATISTICS = (
    "log_chars", "log_words", *(f"{c}_share" for c in _CLASSES), "mean_word", "spread_word", "distinct_words", "top_word",
    "one_letter_words", "odd_ends", "upper_starts", "distinct_lines", "repeated_line_share", "mean_line", "distinct_pairs",
)


def _distinct(values: np.ndarray) -> tuple[int, int]:
    """Number of distinct values and the count of the most frequent one."""
    own = np.sort(values)
    edges = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1], [True])))
    return len(edges) - 1, int(np.diff(edges).max())


def _statistics(piece: Piece) -> np.ndarray:
    n = piece.n
    out = np.zeros((n, len(STATISTICS)))
    lengths = np.diff(piece.offsets)
    owner = np.repeat(np.arange(n), lengths)
    counts = np.bincount(owner * len(_CLASSES) + _CLASS[piece.data], minlength=n * len(_CLASSES)).reshape(n, -1)
    chars = np.maximum(lengths - counts[:, _CLASSES.index("follow")], 1)
    starts, ends, first = piece.spans(BLANK_SEPARATED)
    words, size = piece.hashes(starts, ends), (ends - starts).astype(float)
    line_starts, line_ends, first_line = piece.spans(LINES)
    lines, line_size = piece.hashes(line_starts, line_ends), (line_ends - line_starts).astype(float)
    last, head = _CLASS[piece.data[ends - 1]], _CLASS[piece.data[starts]]
    odd = np.isin(last, [_CLASSES.index(c) for c in ("mark", "symbol", "bracket")])
    upper = head == _CLASSES.index("upper")
    out[:, 0], out[:, 1] = np.log1p(chars), np.log1p(np.diff(first))
    out[:, 2 : 2 + len(_CLASSES)] = counts / chars[:, None]
    at = 2 + len(_CLASSES)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if a == b:
            continue
        k, own = b - a, size[a:b]
        distinct, top = _distinct(words[a:b])
        la, lb = first_line[i], first_line[i + 1]
        distinct_lines, _ = _distinct(lines[la:lb])
        pairs = words[a : b - 1] * np.uint64(3) + words[a + 1 : b]
        repeated = 0.0
        if distinct_lines < lb - la:
            _, where = np.unique(lines[la:lb], return_index=True)
            repeated = 1.0 - line_size[la + where].sum() / line_size[la:lb].sum()
        out[i, at:] = (
            own.mean(), own.std(), distinct / k, top / k, (own == 1).mean(), odd[a:b].mean(), upper[a:b].mean(),
            distinct_lines / (lb - la), repeated, line_size[la:lb].mean(), _distinct(pairs)[0] / (k - 1) if k > 1 else 1.0,
        )
    return out


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text; zeros if it is null or empty."""
    found = [_statistics(p) for p in pieces(texts)]
    return np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS) -> boosting.Trees:
    """Trees for ``labels.quality`` from at most ``rows`` labelled documents outside the held-out fold.

    Several labels of a document are averaged, 0.5 counting as good; null labels are left out. Without any label the
    model gives 0.5 to every text.
    """
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~sampling.held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("key"))
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    sample = sampling.bounded(marked, rows, "key")

    @F.arrow_udf("array<double>")
    def described(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        return pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())

    texts = documents.select(F.col("doc_id").alias("key"), "text")
    # the sample is bounded by `rows`, so that it may be sent to every executor; of rows with one id one is taken
    found = texts.join(F.broadcast(sample), "key")
    once = found.groupBy("key").agg(F.first("good").alias("good"), F.min_by("text", F.xxhash64("text")).alias("text"))
    table = once.select("key", "good", described("text").alias("x")).toArrow()
    x = np.array(table["x"].combine_chunks().flatten()).reshape(-1, len(STATISTICS))
    y = np.array(table["good"].combine_chunks().cast(pa.int8()), dtype=float)
    order = np.lexsort((y, *x.T[::-1], np.array(table["key"].combine_chunks().cast(pa.string()), dtype=str)))
    x, y = x[order], y[order]  # the same rows in the same order give the same trees
    fold = np.arange(len(y)) % 5 == 0
    return boosting.calibrate(boosting.train(x[~fold], y[~fold]), x[fold], y[fold])


def score(model: boosting.Trees, text: Column | str = "text") -> Column:
    """Probability that a text is good, from its whole text. Null and empty texts get a score too."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(model.probability(statistics(texts)), type=pa.float64())

    return scored(text)


def keep_good(documents: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``threshold``, with all their columns."""
    return documents.where(score(model, documents["text"]) >= threshold)


def scores(documents: DataFrame, model: boosting.Trees, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` for every row, repeated rows and null ids included."""
    found = documents.select("doc_id", score(model).alias("score"))
    return found.select(
        "doc_id",
        sampling.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
