"""SentencePiece merge encoding by backtracking over dictionary matches, and decoding."""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from airlens.llm import work

SPACE = "▁"
KEPT = 250_000
PAIRS = 400_000


class Pieces:
    """Encoder of one merge-type (BPE) model with byte fallback and no text normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(lib.get_piece_size()) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i) or lib.is_byte(i))]
        self.score = {lib.id_to_piece(i): lib.get_score(i) for i in plain}
        self.id = {lib.id_to_piece(i): i for i in plain}
        self.byte_id = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        joined = {c for p in self.score if len(p) > 1 for c in p}
        if not joined <= self.id.keys():
            raise ValueError("a character of a longer piece is no piece of its own")
        if any(SPACE in p.lstrip(SPACE) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        # No piece reaches over these borders, so no merge does: what lies between them is encoded on its own.
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        self.split = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else "")).findall
        # A piece whose own merges end elsewhere never stands in an encoding.
        self.text = [""] * lib.get_piece_size()
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.id.items():
            if self.merge(piece) == [piece]:
                self.text[i] = piece
                self.matcher.add_word(piece, (len(piece), i))
        self.matcher.make_automaton()
        self.shorter = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if self.text[self.id.get(p[:k], 0)]), -1) for p in self.text]
        self.single = frozenset(p for p in self.id if len(p) == 1)
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, str]] = {}

    def merge(self, text: str) -> list[str]:
        """Merges by score, the leftmost of equal ones first, until no neighbours form a piece."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether two tokens may stand side by side: merging their joined text anew gives the same two."""
        key = left << 20 | right
        found = self.fits.get(key)
        if found is None:
            a, b = self.text[left], self.text[right]
            if len(self.fits) > PAIRS:
                self.fits = {}
            found = self.fits[key] = self.merge(a + b) == [a, b]
        return found

    def _longest(self, text: str) -> dict[int, int]:
        """Position -> the longest piece that starts there."""
        longest = {}
        for end, (size, i) in self.matcher.iter(text):
            longest[end - size + 1] = i  # ends go up, so the last one is the longest
        return longest

    def _run(self, size: int, at: int, longest: dict[int, int]) -> list[int]:
        """Tokens of ``size`` characters from ``at``, all of which are pieces.

        Takes the longest match that fits its left neighbour, then shorter ones; with none left it marks the position as
        failed, takes the last token back and goes on with a shorter one. Failed positions are never entered again, so
        each is left once.
        """
        tokens: list[int] = []
        open_ = (1 << (size + 1)) - 1
        pos, token = 0, longest[at]
        while pos < size:
            end = pos + len(self.text[token])
            if end <= size and open_ >> end & 1 and (not tokens or self._compatible(tokens[-1], token)):
                tokens.append(token)
                pos = end
                token = longest.get(at + pos, -1)
                continue
            token = self.shorter[token]
            while token < 0:
                open_ &= ~(1 << pos)
                token = tokens.pop()
                pos -= len(self.text[token])
                token = self.shorter[token]
        return tokens

    def _chunk(self, chunk: str, at: int, longest: dict[int, int]) -> list[int]:
        if self.single.issuperset(chunk):
            return self._run(len(chunk), at, longest)
        out: list[int] = []
        start = 0
        for k in range(len(chunk) + 1):
            if k == len(chunk) or chunk[k] not in self.id:
                if k > start:
                    out += self._run(k - start, at + start, longest)
                if k < len(chunk):
                    out += [self.byte_id[b] for b in chunk[k].encode("utf-8", "surrogatepass")]
                start = k + 1
        return out

    def encode(self, text: str | None) -> tuple[bytes, str]:
        """Ids of a whole text as little-endian 32-bit numbers and as decimals joined by commas."""
        if not text:
            return b"", ""
        chunks = self.split(SPACE + text.replace(" ", SPACE))
        parts = list(map(self.known.get, chunks))
        if None in parts:
            if len(self.known) > KEPT:
                self.known = {}
            new = list({c for c, p in zip(chunks, parts, strict=True) if p is None})
            joined = "\0".join(new)
            longest = self._longest(joined)
            fresh, at = {}, 0
            for chunk in new:
                ids = self._chunk(chunk, at, longest)
                fresh[chunk] = (np.array(ids, "<u4").tobytes(), ",".join(map(str, ids)))
                at += len(chunk) + 1
            parts = [fresh[c] if p is None else p for c, p in zip(chunks, parts, strict=True)]
            self.known.update((c, p) for c, p in fresh.items() if len(c) <= 64)
        return b"".join([p[0] for p in parts]), ",".join([p[1] for p in parts])

    def decode(self, ids: bytes) -> str:
        return self.library.decode(np.frombuffer(ids, "<u4").tolist()) if ids else ""


def encode_pieces(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row: encoded as the library for ``path`` does, decoded again.

    ``with_ids`` also returns ``ids`` and ``decoded``. No begin or end ids, no sampling. Null and empty texts have no
    tokens and decode to the empty text. Repeated rows and null ids come out as they are; other columns are ignored.
    """

    def run(doc_ids, texts):
        coder = work.per_process(("pieces", path), functools.partial(Pieces, path))
        coded = [coder.encode(t) for t in texts]
        decoded = [coder.decode(ids) for ids, _ in coded]
        out = {
            "doc_id": doc_ids,
            "n_tokens": [len(ids) // 4 for ids, _ in coded],
            "ids_sha256": [hashlib.sha256(s.encode()).hexdigest() for _, s in coded],
            "decoded_sha256": [hashlib.sha256(work.raw(t)).hexdigest() for t in decoded],
        }
        return out | ({"ids": [np.frombuffer(ids, "<u4") for ids, _ in coded], "decoded": decoded} if with_ids else {})

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return work.map_batches(docs, run, schema, "doc_id", "text")
