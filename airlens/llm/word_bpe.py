"""Token ids and counts of the word-piece vocabulary files (``tokenizers``), with a shortcut for whole-token words."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
from pyspark.sql import DataFrame

from airlens.llm import work

_CANDIDATES = frozenset(chr(c) for c in (9, 10, 11, 12, 13, *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028), 0x20AC))
#: Texts made of these characters only are split here; any other text goes to the library whole. Lower-casing,
#: composition and white space of these do not depend on neighbours or on the Unicode version, and their lower-case
#: forms are among them.
PLAIN = frozenset(c for c in _CANDIDATES if _CANDIDATES.issuperset(c.lower()))
KEPT = 250_000


def _class_of(kind: str) -> str:
    return "".join(re.escape(c) for c in sorted(PLAIN) if unicodedata.category(c)[0] == kind)


class WordBpe:
    """Encoder of one vocabulary file. Words that the file holds whole are looked up, only the rest is merged."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        letters, numbers = _class_of("L"), _class_of("N")
        # The contractions and classes of the vocabulary file's own pattern.
        self.pattern = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\\s{letters}{numbers}]+")
        self.spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.whole = self._prove_whole()
        self.as_bytes = [i.to_bytes(4, "little") for i in range(self.library.get_vocab_size())]
        self.known: dict[str, bytes] = {}

    def _prove_whole(self) -> dict[str, bytes]:
        """Strings of the vocabulary that are one pre-token and that the library encodes, alone, as one token."""
        from tokenizers import decoders

        text_of = decoders.ByteLevel().decode
        ends = [w.removesuffix("</w>") for w in self.library.get_vocab() if w.endswith("</w>") and w not in self.special]
        words = sorted({w for w in (text_of([x]) for x in ends if x) if PLAIN.issuperset(w) and w == w.lower() and self.pattern.fullmatch(w)})
        found = self.library.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.array(e.ids, "<u4").tobytes() for w, e in zip(words, found, strict=True) if len(e.ids) == 1}

    def _plain(self, text: str) -> bool:
        """Whether words of the text can be told apart here; otherwise the library has to do it."""
        if not (text.isascii() and text.isprintable()) and not PLAIN.issuperset(text):
            return False
        return "<|" not in text or not any(s in text for s in self.special)

    def _merge(self, token: str) -> bytes:
        """Ids of one pre-token that is no whole token."""
        if not token.isascii():
            token = self.spelled(token)[0][0]
        return b"".join([self.as_bytes[t.id] for t in self.library.model.tokenize(token)])

    def _word(self, word: str) -> bytes:
        """Ids of a word between white space: whole tokens are looked up, only other pre-tokens are merged."""
        whole = self.whole.get
        return b"".join([whole(t) or self._merge(t) for t in self.pattern.findall(word)])

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit numbers; null is empty."""
        if not text:
            return b""
        if not self._plain(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = text.lower().split()
        parts = list(map(self.known.get, words))
        if None in parts:
            if len(self.known) > KEPT:
                self.known = {}
            for i, part in enumerate(parts):
                if part is None:
                    word = words[i]
                    parts[i] = part = self.known.get(word) or self._word(word)
                    if len(word) <= 64:
                        self.known[word] = part
        return b"".join(parts)


def encoder(path: str) -> WordBpe:
    return work.per_process(("word_bpe", path), lambda: WordBpe(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row: tokens as the library for ``path`` gives them.

    Nothing is added, cut or padded; strings of special tokens inside a text count as the library's default has them.
    Null and empty texts: 0 bytes, 0 tokens. Rows are counted one by one: repeated rows and null ids come out as they
    are. Other columns are ignored.
    """

    def run(ids, texts):
        bpe = encoder(path)
        tokens = [len(bpe.encode(t)) // 4 for t in texts]
        return {"doc_id": ids, "n_bytes": [len(work.raw(t)) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]}

    return work.map_batches(docs, run, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "doc_id", "text")
