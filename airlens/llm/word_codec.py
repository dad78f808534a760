"""Encoding and decoding with a word-piece vocabulary file: frequent words by a transducer, all others by merging."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import lexicon, work
from airlens.llm.word_bpe import WordBpe

#: Words of the lexicon; counters a task keeps to find them; merged words a worker remembers and their longest; characters
#: of texts whose words are looked up together.
WORDS, COUNTERS, REMEMBERED, LONGEST, TOGETHER = 60_000, 1 << 18, 200_000, 48, 4_000_000


def frequent_words(docs: DataFrame, path: str, words: int = WORDS, counters: int = COUNTERS) -> list[str]:
    """The ``words`` most frequent words (lower case, between white space) of all documents; ties by the word.

    Each task counts in at most twice ``counters`` places: when they are full, all are lowered by the count that frees
    half of them. A word with more than a ``counters``-th of a task's words keeps a place there, and only such words leave
    the task. Results of encoding do not depend on which words these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = work.per_process(("word_bpe", path), lambda: WordBpe(path))
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if text and bpe._plain(text):
                    counts.update(text.lower().split())
                    if len(counts) > 2 * counters:
                        values = np.fromiter(counts.values(), np.int64, len(counts))
                        least = int(np.partition(values, len(values) - counters)[len(values) - counters])
                        counts = Counter({w: n - least for w, n in counts.items() if n > least})
        least = sum(counts.values()) // counters
        kept = [(w, n) for w, n in counts.items() if n > least and len(w) <= LONGEST]
        for at in range(0, len(kept), 10_000):
            w, n = zip(*kept[at : at + 10_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    found = docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in found.orderBy(F.desc("n"), "word").limit(words).collect()]


def build(docs: DataFrame, path: str, words: int = WORDS) -> str:
    """Compiles the frequent words of ``docs`` with their ids; name of the lexicon for ``encode`` and ``round_trips``."""
    bpe = WordBpe(path)
    entries = {w.encode(): np.frombuffer(bpe._word(w), "<u4").tolist() for w in frequent_words(docs, path, words)}
    return lexicon.published(docs.sparkSession, lexicon.compiled(entries))


class Codec:
    """A vocabulary file with a lexicon of frequent words."""

    def __init__(self, path: str, name: str):
        from tokenizers import pre_tokenizers

        self.bpe = WordBpe(path)
        self.lexicon = lexicon.mapped(name)
        library = self.bpe.library
        n = library.get_vocab_size()
        self.tokens = [library.id_to_token(i) for i in range(n)]
        self.digits = [str(i) for i in range(n)]
        # the byte alphabet of the vocabulary: each byte of UTF-8 as one character
        spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.alphabet = {c: spelled(c)[0][0] for c in (chr(i) for i in range(128, 0x2100))}
        self.spelled = spelled
        self.merged: dict[str, bytes] = {}

    def _merge(self, word: str) -> bytes:
        """Ids of a word by exact merging of each pre-token that is no whole token."""
        out, as_bytes = b"", self.bpe.as_bytes
        for token in self.bpe.pattern.findall(word):
            whole = self.bpe.whole.get(token)
            if whole is not None:
                out += whole
                continue
            if not token.isascii():
                alphabet = self.alphabet
                try:
                    token = "".join([c if c < "\x80" else alphabet[c] for c in token])
                except KeyError:
                    token = self.spelled(token)[0][0]
            out += b"".join([as_bytes[t.id] for t in self.bpe.library.model.tokenize(token)])
        return out

    def entries(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word as little-endian 32-bit numbers: frequent ones from the lexicon, the rest by exact merging, remembered for a while."""
        unseen = list(words.difference(self.merged))
        ranks = self.lexicon.find([w.encode() for w in unseen])
        found = np.flatnonzero(ranks >= 0)
        out = {unseen[i]: ids for i, ids in zip(found.tolist(), self.lexicon.outputs(ranks[found]), strict=True)}
        rare = [unseen[i] for i in np.flatnonzero(ranks < 0).tolist()]
        known = self.merged
        out |= {w: known[w] for w in words.intersection(known)}
        if len(known) + len(rare) > REMEMBERED:
            known = self.merged = {}
        for word in rare:
            out[word] = ids = self._merge(word)
            if len(word) <= LONGEST:
                known[word] = ids
        return out

    def ids(self, texts: list[str | None]) -> Iterator[list[int]]:
        """Ids of each text in order, words of many texts looked up together. Null is empty."""
        at = 0
        while at < len(texts):
            split, size = [], 0
            while at < len(texts) and size < TOGETHER:
                text = texts[at] or ""
                size += len(text)
                split.append((text.lower().split(), None) if self.bpe._plain(text) else ((), text))
                at += 1
            get = self.entries(set().union(*(words for words, _ in split))).__getitem__
            for words, whole in split:
                if whole is None:
                    yield np.frombuffer(b"".join(map(get, words)), "<u4").tolist()
                else:  # only the library can split this text
                    yield self.bpe.library.encode(whole, add_special_tokens=False).ids


def codec(path: str, name: str) -> Codec:
    return work.per_process(("word_codec", path, name), lambda: Codec(path, name))


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, path: str, name: str) -> DataFrame:
    """``doc_id, ids array<int>`` of every row: ids as the library for ``path`` gives them, nothing added, cut or padded.

    Special strings inside a text become special ids, as by the library's default. Null and empty texts: no ids. Repeated
    rows and null ids come out as they are; other columns are ignored. A text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _batches(batches):
            ids = list(codec(path, name).ids(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` of ``rows(doc_id, ids)``: token strings joined by one space, special ones too, as the library's
    ``decode(ids, skip_special_tokens=False)`` has them for a file without a decoder. Ids that are not in the vocabulary
    are left out; null ids give a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = work.per_process(("word_bpe", path), lambda: WordBpe(path))
        token = bpe.library.id_to_token
        for batch in _batches(batches):
            texts = [None if ids is None else " ".join([t for t in (token(i) for i in ids if i is not None and i >= 0) if t is not None]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def round_trips(docs: DataFrame, path: str, name: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: ``encode`` then ``decode`` in one pass, hashed.

    Hashes are of the decimal ids joined by one space and of the decoded text in UTF-8. Odd input as for ``encode``.
    """

    def sha(parts: Iterator[str]) -> str:
        return hashlib.sha256(" ".join(parts).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = codec(path, name)
            digits, token = held.digits.__getitem__, held.tokens.__getitem__
            rows = [(len(ids), sha(map(digits, ids)), sha(map(token, ids))) for ids in held.ids(batch.column("text").to_pylist())]
            sizes, encoded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
