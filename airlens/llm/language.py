"""Language of documents: blended-spectrum presence kernels, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import work
from airlens.llm.features import bounded_per_class

BITS = 15
ORDERS = 3
#: Labelled rows that a model is fitted on, over all languages, at most.
SAMPLE = 2400
LANDMARKS = 256
SLICE = 1 << 20
SHARPNESS = 6.0
BATCH = 64


def spectrum(text: str | None) -> np.ndarray:
    """Presence of the byte n-grams (1 to 3) of the lower-cased text, hashed to 2**15 places."""
    data = np.frombuffer(work.raw((text or "").lower()), np.uint8)
    hit = np.zeros(1 << BITS, bool)
    for at in range(0, len(data), SLICE):
        part = data[at : at + SLICE + ORDERS - 1].astype(np.uint64)
        code = np.zeros(len(part), np.uint64)
        for n in range(1, min(ORDERS, len(part)) + 1):
            code = (code[: len(part) - n + 1] << np.uint64(8)) | part[n - 1 :]
            hit[((code + np.uint64(n << 32)) * work.GOLDEN >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return hit


def kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shared n-grams of every pair of rows, over the root of the product of their numbers."""
    a, b = a.astype(np.float32), b.astype(np.float32)
    return (a @ b.T) / np.sqrt(np.maximum(a.sum(1), 1)[:, None] * np.maximum(b.sum(1), 1)[None, :])


@dataclass
class Model:
    """``weight``: the landmarks' presence rows times their dual weights, a column a language.

    The kernel is a dot product of presence rows, so summing landmarks first gives the same scores in one product.
    """

    languages: list[str]
    weight: np.ndarray

    def margins(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.astype(np.float32)
        return rows @ self.weight / np.sqrt(np.maximum(rows.sum(1), 1))[:, None]


def fit(rows: np.ndarray, languages: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> Model:
    names = sorted(set(languages))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), np.float32))
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    own = rows[np.random.default_rng(3).permutation(len(rows))[:landmarks]]
    k_nm, k_mm = kernel(rows, own).astype(np.float64), kernel(own, own).astype(np.float64)
    dual = np.linalg.solve(k_nm.T @ k_nm + ridge * len(rows) / 100 * k_mm + 1e-6 * np.eye(len(own)), k_nm.T @ target)
    scaled = own.astype(np.float64) / np.sqrt(np.maximum(own.sum(1), 1))[:, None]
    return Model(names, (scaled.T @ dual).astype(np.float32))


def train(docs: DataFrame, sample: int = SAMPLE, left_out: tuple[int, int] = (4, 2)) -> Model:
    """A model from documents with a language whose crc32(doc_id as text) modulo ``left_out[0]`` is not ``left_out[1]``.

    At most ``sample`` rows over all languages, alike for each, chosen by hash: only their ids (a bounded table) travel. Of
    rows that share a doc_id the one with the smallest hash of text and language counts, so their order does not matter.
    """
    modulus, held = left_out
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (work.crc_mod("doc_id", modulus) != held))
    usable = usable.select("doc_id", "lang", "text", F.xxhash64("text", "lang").alias("h"))
    one = usable.groupBy("doc_id").agg(F.min(F.struct("h", "lang")).alias("m")).select("doc_id", "m.lang")
    n = one.select("lang").distinct().count()
    chosen = F.broadcast(bounded_per_class(one, "lang", max(1, sample // max(1, n))).select("doc_id"))

    def run(languages, texts):
        return {"lang": languages, "found": [np.packbits(spectrum(t)).tobytes() for t in texts]}

    joined = usable.join(chosen, "doc_id").groupBy("doc_id").agg(F.min(F.struct("h", "lang", "text")).alias("m")).select("m.lang", "m.text")
    found = work.map_batches(joined, run, "lang string, found binary", "lang", "text").toArrow()
    pairs = sorted(zip(found["lang"].to_pylist(), found["found"].to_pylist(), strict=True), key=lambda p: (xxhash.xxh3_64_intdigest(p[1]), p[0]))
    rows = np.array([np.unpackbits(np.frombuffer(p, np.uint8)) for _, p in pairs], bool).reshape(len(pairs), 1 << BITS)
    return fit(rows, [lang for lang, _ in pairs])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row. Only the text is an input of the prediction.

    Null texts and texts without a letter: ``und``, score 0. Else the language with the largest margin and its share among all
    (0 to 1). held_out: crc32(doc_id as text) modulo 4 is 2 (false for a null id). Repeated rows come out as they are;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 weights a language

    def run(ids, held, texts):
        names = shared.value.languages
        lang, sure = ["und"] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if names and t and any(map(str.isalpha, t))]
        for at in range(0, len(known), BATCH):
            part = known[at : at + BATCH]
            margin = shared.value.margins(np.stack([spectrum(texts[i]) for i in part])) * SHARPNESS
            share = np.exp(margin - margin.max(1, keepdims=True))
            share /= share.sum(1, keepdims=True)
            for i, best, s in zip(part, share.argmax(1), share.max(1), strict=True):
                lang[i], sure[i] = names[best], s
        return {"doc_id": ids, "held_out": held, "lang_pred": lang, "score": sure}

    marked = docs.select("doc_id", F.coalesce(work.crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return work.map_batches(marked, run, "doc_id bigint, held_out boolean, lang_pred string, score double", "doc_id", "held_out", "text")
