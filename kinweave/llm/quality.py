"""Document quality by a linear-chain conditional random field over lines.

Every line has features of its own (length, words, variety of words, shares of kinds of characters, whether it repeats an
earlier line) and those of the lines before and after it. The field labels each line good or bad; its forward-backward
marginals, weighted by the lengths of the lines, give the share of a document that is good, which a logistic curve turns
into the score. Labels are known for documents only: training starts with every line of a document bearing the document's
label, then lines of bad documents that the field itself takes for good are relabelled, and it is trained again.

The field is fitted on at most ``train_docs`` labelled documents (those of the smallest hash of the id) of at most
``train_lines`` lines together; their whole texts are read where they lie, and only the features of their lines go to the
driver. Every document is scored. Neither labels nor id, language or source enter a score. Texts are worked on in chunks
of about ``CHUNK_BYTES``; a longer one is a chunk of its own.

Defined results: a null text is scored as an empty one, which is one empty line; repeated rows get equal scores; a null id
is scored and never trained on; contradicting labels of one id count as the smaller; with no labels, or labels of one
kind, every score is the share of label 1 (1.0 without any); an empty table gives an empty result; ``accepted`` carries
every column through unchanged, whatever its name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch

#: Bytes of texts, about, whose lines are worked on together.
CHUNK_BYTES = 1_000_000
#: Kinds of bytes: blank, upper case, lower case, digit, punctuation, bar, beyond ASCII, line feed.
_KIND = np.full(256, 6, np.uint8)
_KIND[:128] = 4
_KIND[[9, 11, 12, 13, 32]] = 0
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[124], _KIND[10] = 1, 2, 3, 5, 7
OWN = 13


@dataclass
class Field:
    """A few hundred numbers: broadcast with the task."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of good against bad, one for each feature and a constant
    moves: np.ndarray  # (2, 2): from bad or good to bad or good
    slope: float
    shift: float
    constant: float | None = None


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each line's own features (lines, OWN), lengths of the lines in characters and number of lines of each text."""
    counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
    n = int(counts.sum())
    kinds = _KIND[np.frombuffer(("\n".join(texts) + "\n").encode(), np.uint8)]
    starts = np.concatenate([[0], np.flatnonzero(kinds == 7)[:-1] + 1])  # each line has its line feed at least
    by_kind = np.column_stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in range(7)]).astype(np.float64)
    del kinds
    words, different, repeated, chars = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    i = 0
    for t in texts:
        seen: set[str] = set()
        for x in t.split("\n"):
            w = x.split()
            words[i], different[i], chars[i] = len(w), len(set(w)), len(x)
            if x in seen:
                repeated[i] = 1
            elif x:
                seen.add(x)
            i += 1
    size = by_kind.sum(1)
    share = by_kind / np.maximum(size, 1)[:, None]
    letters = np.maximum(by_kind[:, 1] + by_kind[:, 2] + by_kind[:, 6], 1)
    marks = (by_kind[:, 4] + by_kind[:, 5]) / np.maximum(words, 1)
    own = np.column_stack([np.log1p(size), np.log1p(words), different / np.maximum(words, 1), np.log1p(words - different), by_kind[:, 1] / letters, share[:, 3], share[:, 4], share[:, 5], share[:, 6], np.minimum(marks, 8), size / np.maximum(words, 1) / 8, repeated, words == 0])
    own[:, 10] = np.minimum(own[:, 10], 8)
    return own, chars, counts


def beside(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the lines before and after have in ``own``; zeros where a document begins or ends."""
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    ends = np.cumsum(counts)
    before[ends[:-1]] = 0
    after[ends - 1] = 0
    return before, after


def line_odds(own: np.ndarray, counts: np.ndarray, field: Field) -> np.ndarray:
    """Score of good against bad of each line; neighbours are added as one number each, not as features."""
    w = field.weights[:-1] / field.scale
    before, after = beside(own @ w.reshape(3, OWN)[1:].T, counts)
    return own @ w[:OWN] + before[:, 0] + after[:, 1] + field.weights[-1] - field.mean @ w


#: So few documents go on line by line.
FEW = 4


def _steps(state: np.ndarray, odds: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The states (log sums of bad and good) behind each of the ``odds``, from the one before them."""
    (m00, m01), (m10, m11) = moves.tolist()
    f0, f1 = state.tolist()
    out = []
    for o in odds.tolist():
        a, b, c, d = f0 + m00, f1 + m10, f0 + m01, f1 + m11
        f0 = max(a, b) + math.log1p(math.exp(-abs(a - b)))
        f1 = max(c, d) + math.log1p(math.exp(-abs(c - d))) + o
        out.append((f0, f1))
    return np.array(out).reshape(-1, 2)


def marginals(odds: np.ndarray, counts: np.ndarray, moves: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line; expected numbers of moves; log of the partition sums. odds: score of good against bad.

    All documents go forward and backward together, longest first; the last few, line by line.
    """
    order = np.argsort(-counts, kind="stable")
    start = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    n, steps = len(odds), int(length[0]) if len(length) else 0
    forward, backward = np.zeros((n, 2)), np.zeros((n, 2))
    emit = np.column_stack([np.zeros(n), odds])
    live = np.searchsorted(-length, -np.arange(steps + 1), side="left").tolist()  # documents of more than t lines
    together = max(1, int(np.searchsorted(-np.array(live), -FEW, side="left")))  # FEW or fewer have more lines than that
    at = start[: live[0]]
    f = emit[at]
    forward[at] = f
    for t in range(1, min(steps, together)):
        at = start[: live[t]] + t
        p = forward[at - 1]
        f0 = np.logaddexp(p[:, 0] + moves[0, 0], p[:, 1] + moves[1, 0])
        f1 = np.logaddexp(p[:, 0] + moves[0, 1], p[:, 1] + moves[1, 1])
        forward[at] = np.column_stack([f0, f1]) + emit[at]
    for a, b in zip(start[: live[min(together, steps)]].tolist(), length.tolist()):
        lo = together
        forward[a + lo : a + b] = _steps(forward[a + lo - 1], odds[a + lo : a + b], moves)
        # Backward the same steps, on sums that hold the line's own odds already.
        last = np.array([0.0, odds[a + b - 1]])
        back = _steps(last, odds[a + lo : a + b - 1][::-1], moves.T)[::-1]
        backward[a + lo : a + b - 1] = back - emit[a + lo : a + b - 1]
    for t in range(min(steps - 2, together - 1), -1, -1):
        at = start[: live[t + 1]] + t
        q = backward[at + 1] + emit[at + 1]
        backward[at, 0] = np.logaddexp(q[:, 0] + moves[0, 0], q[:, 1] + moves[0, 1])
        backward[at, 1] = np.logaddexp(q[:, 0] + moves[1, 0], q[:, 1] + moves[1, 1])
    both = forward + backward
    total = np.logaddexp(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    expected = np.zeros((2, 2))
    if pairs and n:
        inner = np.ones(n, bool)
        inner[np.cumsum(counts) - 1] = False
        a = np.flatnonzero(inner)
        for i in range(2):
            for j in range(2):
                expected[i, j] = np.exp(forward[a, i] + moves[i, j] + emit[a + 1, j] + backward[a + 1, j] - total[a]).sum()
    return good, expected, float(total[np.cumsum(counts) - counts].sum())


def _fit_field(x: np.ndarray, counts: np.ndarray, labels: np.ndarray, w: np.ndarray, moves: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Adam on the conditional log-likelihood of the line labels, with a weight decay of 1."""
    inner = np.ones(len(x), bool)
    inner[np.cumsum(counts) - 1] = False
    a = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[a], labels[a + 1]), 1)
    theta, m, v = np.concatenate([w, moves.ravel()]), 0.0, 0.0
    for k in range(1, rounds + 1):
        w, moves = theta[:-4], theta[-4:].reshape(2, 2)
        good, expected, _ = marginals(x @ w, counts, moves, True)
        g = np.concatenate([x.T @ (labels - good) - w, (seen - expected).ravel() - moves.ravel()]) / len(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _shares(good: np.ndarray, chars: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each document."""
    first = np.cumsum(counts) - counts
    weight = chars + 1.0
    return np.add.reduceat(good * weight, first) / np.add.reduceat(weight, first)


def train(lines: tuple[np.ndarray, np.ndarray, np.ndarray], quality: list[int], rounds: int = 80) -> Field:
    """From what ``line_features`` gives for the documents, and their labels."""
    y = np.array(quality, np.int64)
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(1), np.ones(1), np.zeros(1), np.zeros((2, 2)), 0, 0, float(y.mean()) if len(y) else 1.0)
    own, chars, counts = lines
    x = np.hstack([own, *beside(own, counts)])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    x = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    doc = np.repeat(np.arange(len(y)), counts)
    labels = y[doc]
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    for _ in range(3):
        w, moves = _fit_field(x, counts, labels, w, moves, rounds)
        good = marginals(x @ w, counts, moves)[0]
        labels = np.where(y[doc] == 1, 1, (good > 0.5).astype(np.int64))
        worst = np.minimum.reduceat(good, np.cumsum(counts) - counts)
        labels[(good <= worst[doc]) & (y[doc] == 0)] = 0
    share = _shares(good, chars, counts)
    z = np.column_stack([_logit(share), np.ones(len(y))])
    theta = np.zeros(2)
    for _ in range(30):  # Newton's method, with a small decay
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(2)
        theta = theta + np.linalg.solve(h, z.T @ (y - p) - 0.1 * theta)
    return Field(mean, scale, w, moves, float(theta[0]), float(theta[1]))


def _logit(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-3, 1 - 1e-3)
    return np.log(share / (1 - share))


def score_texts(texts: list[str], field: Field) -> np.ndarray:
    if field.constant is not None:
        return np.full(len(texts), field.constant)
    own, chars, counts = line_features(texts)
    share = _shares(marginals(line_odds(own, counts, field), counts, field.moves)[0], chars, counts)
    return 1 / (1 + np.exp(-np.clip(field.slope * _logit(share) + field.shift, -30, 30)))


def held_out(id_col: Column, folds: int = 5) -> Column:
    """Documents that no field is ever trained on: crc32 of the id as text is divisible by ``folds``."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_lines: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field from at most ``train_docs`` labelled documents that are not held out, of at most ``train_lines`` lines."""
    known = labels.select(F.col(id_col).alias("kw_id"), F.col(label_col).cast("int").alias("kw_label")).filter(F.col("kw_id").isNotNull() & F.col("kw_label").isin(0, 1) & ~held_out(F.col("kw_id")))
    known = known.groupBy("kw_id").agg(F.min("kw_label").alias("kw_label")).orderBy(F.xxhash64("kw_id"), "kw_id").limit(train_docs)
    mine = docs.select(F.col(f"`{id_col}`").alias("kw_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("kw_text"))
    rows = mine.join(F.broadcast(known), "kw_id").groupBy("kw_id").agg(F.min("kw_text").alias("text"), F.first("kw_label").alias("label"))
    schema = T.StructType([T.StructField("kw_id", rows.schema["kw_id"].dataType), *(T.StructField(c, T.LongType()) for c in ("label", "lines")), T.StructField("own", T.BinaryType()), T.StructField("chars", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                own, chars, counts = line_features([text.as_py()])
                one = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([one["kw_id"], one["label"].cast(pa.int64()), pa.array([int(counts[0])], pa.int64()), pa.array([own.astype("<f4").tobytes()], pa.binary()), pa.array([chars.astype("<f4").tobytes()], pa.binary())], names=schema.names)

    lines = scratch.table(rows.mapInArrow(run, schema))
    before = F.sum("lines").over(Window.orderBy(F.xxhash64("kw_id"), "kw_id").rowsBetween(Window.unboundedPreceding, 0))
    few = lines.filter(F.col("lines") <= train_lines).select("kw_id", "lines").withColumn("kw_sum", before).filter(F.col("kw_sum") <= train_lines).select("kw_id")  # of train_docs rows
    picked = lines.join(F.broadcast(few), "kw_id", "left_semi").orderBy("kw_id").collect()  # bounded: train_lines
    scratch.drop(lines)
    own = np.frombuffer(b"".join(bytes(r["own"]) for r in picked), "<f4").reshape(-1, OWN).astype(np.float64)
    chars = np.frombuffer(b"".join(bytes(r["chars"]) for r in picked), "<f4").astype(np.float64)
    return train((own, chars, np.array([r["lines"] for r in picked], np.int64)), [r["label"] for r in picked])


def _batches(batches: Iterator[pa.RecordBatch], at: int, field: Field) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and the scores of their texts, which are column ``at``."""
    for whole in batches:
        lo = 0
        while lo < whole.num_rows:
            size = hi = 0
            for hi in range(lo, whole.num_rows):
                size += len(whole.column(at)[hi].as_py() or "")
                if size >= CHUNK_BYTES:
                    break
            part = whole.slice(lo, hi + 1 - lo)
            yield part, score_texts([x or "" for x in part.column(at).to_pylist()], field)
            lo = hi + 1


def score(docs: DataFrame, field: Field, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _batches(batches, 1, field):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64())], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, field: Field, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, all columns as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, scores in _batches(batches, at, field):
            yield part.filter(pa.array(scores >= threshold))

    return docs.mapInArrow(run, docs.schema)
