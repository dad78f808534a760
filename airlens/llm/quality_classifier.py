"""Quality classifier: naive Bayes log-count ratios scale n-gram indicators, a linear hinge-loss model weighs them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import work
from airlens.llm.features import bounded_per_class, sigmoid

BITS = 18
#: Labelled rows of each class that a model is fitted on, at most.
SAMPLE = 3000
SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()’\-]")


def shape_of(word: str) -> int:
    """One of 24 shapes: case or kind of the word, symbols in it, how it ends."""
    if word.islower():
        kind = 0
    elif word.istitle():
        kind = 1
    elif word.isupper():
        kind = 2
    elif any(c.isdigit() for c in word):
        kind = 3
    else:
        kind = 4 if any(map(str.isalpha, word)) else 5
    end = 1 if word[-1] in ".?" else 0
    return kind * 4 + 2 * bool(SYMBOL.search(word)) + end


def indicators(text: str | None) -> np.ndarray:
    """Sorted numbers of the n-grams that occur: lower-cased words (1, 2) and word shapes (1 to 4), hashed to 2**18.

    A shape also says whether the word repeats the one before it. No words: none.
    """
    words = (text or "").split()
    if not words:
        return np.empty(0, np.int64)
    shapes = work.per_process(("word shapes",), dict)
    if len(shapes) > 100_000:
        shapes.clear()
    found = list(map(shapes.get, words))
    for i, s in enumerate(found):
        if s is None:
            found[i] = shapes[words[i]] = shape_of(words[i])
    low = work.hashes_of([w.encode("utf-8", "surrogatepass") for w in text.lower().split()])
    shape = np.array(found, np.uint64) + np.uint64(1)
    shape[1:] += np.uint64(32) * (low[1:] == low[:-1] if len(low) == len(words) else np.zeros(len(words) - 1, bool))
    grams = [low, work.windows_of(low, 2)]
    code = np.zeros(len(shape), np.uint64)
    for n in range(1, min(4, len(shape)) + 1):
        code = (code[: len(shape) - n + 1] << np.uint64(6)) | shape[n - 1 :]
        grams.append(work.mixed(code + np.uint64(n << 40)))
    hit = np.zeros(1 << BITS, bool)
    hit[(np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(hit)


@dataclass
class Model:
    """``weight`` per indicator (ratio and hinge weight in one), bias, and the two numbers that turn a margin into a score."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weight[found].sum(dtype=np.float64) / np.sqrt(max(1, len(found)))) + self.bias

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.slope * self.margin(indicators(text)) + self.offset))


def fit(rows: list[np.ndarray], quality: np.ndarray, alpha: float = 1.0, cost: float = 1.0, keep: float = 0.25, epochs: int = 12) -> Model:
    """A model from indicators and labels 0/1.

    Ratios: log of the classes' smoothed shares of documents with an indicator. The scaled rows are fitted with the hinge loss
    by dual coordinate descent; the weights are drawn towards their mean size by ``keep`` (the published interpolation).
    Scores are a logistic fit of the margins. With one class only, or no rows, scores are that class's share.
    """
    y = np.where(quality == 1, 1.0, -1.0)
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        p = 0.5 if not len(y) else float(np.clip((y > 0).mean(), 0.02, 0.98))
        return Model(np.zeros(size, np.float32), 0.0, 1.0, float(np.log(p / (1 - p))))
    share = []
    for sign in (1.0, -1.0):
        counts = np.bincount(np.concatenate([r for r, s in zip(rows, y, strict=True) if s == sign]), minlength=size)
        share.append((counts + alpha) / ((y == sign).sum() + 2 * alpha))
    ratio = np.log(share[0] / share[1])
    scaled = [ratio[r] / np.sqrt(max(1, len(r))) for r in rows]
    square = np.array([float(x @ x) + 1.0 for x in scaled])
    limit = cost * np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    w, bias, dual = np.zeros(size), 0.0, np.zeros(len(y))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            gradient = y[i] * (float(w[rows[i]] @ scaled[i]) + bias) - 1.0
            new = min(max(dual[i] - gradient / square[i], 0.0), limit[i])
            if new != dual[i]:
                step = (new - dual[i]) * y[i]
                w[rows[i]] += step * scaled[i]
                bias += step
                dual[i] = new
    used = w != 0
    mean = np.abs(w[used]).mean() if used.any() else 0.0
    weight = (((1 - keep) * mean * used + keep * w) * ratio).astype(np.float32)
    model = Model(weight, bias * keep, 1.0, 0.0)
    margins = np.array([model.margin(r) for r in rows])
    return Model(weight, bias * keep, *_logistic(margins, y > 0))


def _logistic(margin: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, targets drawn in from 0 and 1; classes count alike."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(positive, 0.5 / n1, 0.5 / n0)
    scale = np.abs(margin).mean() or 1.0
    x = np.stack([margin / scale, np.ones_like(margin)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(60):
        p = sigmoid(x @ theta)
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        theta += np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-4 * theta)
    return float(theta[0] / scale), float(theta[1])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, left_out: tuple[int, int] = (3, 1)) -> Model:
    """A model from labelled documents whose crc32(doc_id as text) modulo ``left_out[0]`` is not ``left_out[1]``.

    At most ``sample`` rows of each class, chosen by hash. Labels that are null or contradict each other do not count, nor
    do those without a document. Only the chosen ids (a bounded table) travel to the documents.
    """
    modulus, held = left_out
    clean = (
        labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (work.crc_mod("doc_id", modulus) != held))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
        .select("doc_id", "quality")
    )
    chosen = F.broadcast(bounded_per_class(clean, "quality", sample))

    def run(quality, texts):
        return {"quality": quality, "found": [indicators(t).astype("<u4").tobytes() for t in texts]}

    # One row of repeated ids, the smallest by a hash of its text: the sample's bound holds for documents, too.
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct("h", "text")).alias("m")).select("quality", "m.text")
    found = work.map_batches(texts, run, "quality int, found binary", "quality", "text").toArrow()
    rows = [np.frombuffer(x.as_py(), "<u4").astype(np.int64) for x in found["found"]]
    quality = np.array(found["quality"].to_pylist(), np.int64)
    order = sorted(range(len(rows)), key=lambda i: (quality[i], xxhash.xxh3_64_intdigest(rows[i].tobytes())))
    return fit([rows[i] for i in order], quality[order])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row. Only the text is an input of the score.

    Null and empty texts get the score of a text without indicators. held_out: crc32(doc_id as text) modulo 3 is 1 (false
    for a null id). Repeated rows come out as they are; other columns are ignored.
    """
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)  # 2**18 weights whatever the input

    def run(ids, held, texts):
        scores = [shared.value.score(t) for t in texts]
        return {"doc_id": ids, "held_out": held, "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    marked = docs.select("doc_id", F.coalesce(work.crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "text")
    return work.map_batches(marked, run, "doc_id bigint, held_out boolean, score double, predicted int", "doc_id", "held_out", "text")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model predicts 1 for, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return work.select_rows(docs, lambda texts: ([shared.value.score(t) >= 0.5 for t in texts], None))
