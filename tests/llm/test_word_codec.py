"""The transducer against a plain dictionary, the codec against the tokenizer library."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from airlens.llm import lexicon, word_codec

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_transducer_holds_its_words_and_no_others(tmp_path):
    rng = random.Random(1)
    words = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 7))) for _ in range(900)} | {"éa".encode(), b"\xff"}
    entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 4))] for w in words}
    path = tmp_path / "x"
    path.write_bytes(lexicon.compiled(entries))
    held = lexicon.Lexicon(str(path))
    order = sorted(words)
    ranks = held.find(order)
    assert ranks.tolist() == list(range(len(order)))
    assert held.outputs(ranks) == [struct.pack(f"<{len(entries[w])}I", *entries[w]) for w in order]
    others = [w + b"a" for w in words if w + b"a" not in words] + [w[:-1] for w in words if w[:-1] not in words] + [b"", b"z" * 10_000]
    assert (held.find(others) == -1).all()


def test_transducer_is_minimal(tmp_path):
    """States of the smallest automaton: one for each different set of endings."""
    words = {b"tap", b"taps", b"top", b"tops", b"stop", b"stops", b"s"}
    ends = {tuple(sorted(w[len(p) :] for w in words if w.startswith(p))) for w in words for p in (w[:i] for i in range(len(w) + 1))}
    path = tmp_path / "x"
    path.write_bytes(lexicon.compiled({w: [1] for w in words}))
    assert len(lexicon.Lexicon(str(path)).final) == len(ends)


def test_empty_transducer(tmp_path):
    path = tmp_path / "x"
    path.write_bytes(lexicon.compiled({}))
    assert lexicon.Lexicon(str(path)).find([b"a", b""]).tolist() == [-1, -1]


TEXTS = [
    None,
    "",
    "   \t\n ",
    "The cat sat on the mat. The CAT'S hat, isn't it? 3.14 2024",
    "Ünïcode ümläut straße ŒUVRE Ǆ ǅ İstanbul ΑΒΓ Σίσυφος",
    "日本語のテキスト 中文 한국어 العربية हिन्दी",
    "special <|endoftext|> inside <|startoftext|> and <| endoftext |>",
    "emoji 🙂👩‍👩‍👧 combining é å   nbsp em \x85 next",
    "x" * 5000 + " " + "ab" * 3000,
    "zero\x00width​space ﻿bom",
    "I'LL we've THEY'RE 'twas ''s 's'",
]


def expected(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("words", [0, 3, 60_000])
def test_round_trips_are_the_library_s(spark, make, library, words):
    rng = random.Random(words)
    pieces = ["the", "The", "thrombus", "qzx", "naïve", "end.", "(so)", "a,b", "1999", "don't", "é", "ß", "ž", "<|endoftext|>"]
    items = [*enumerate(TEXTS), *((100 + i, " ".join(rng.choice(pieces) for _ in range(rng.randint(1, 60)))) for i in range(200)), (3, TEXTS[3]), (None, "a b")]
    docs = make(items)
    name = word_codec.build(docs, PATH, words)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_codec.round_trips(docs, PATH, name).collect())
    assert got == sorted((i is None, i or 0, *expected(library, t)) for i, t in items)


def test_encode_then_decode(spark, make, library):
    docs = make(list(enumerate(TEXTS)))
    name = word_codec.build(docs, PATH)
    encoded = word_codec.encode(docs, PATH, name)
    for r in encoded.collect():
        assert r.ids == library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
    for r in word_codec.decode(encoded, PATH).collect():
        assert r.text == library.decode(library.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_frequent_words_with_few_counters(spark, make):
    """Few places: a word with more than its share of the words is always found."""
    rng = random.Random(4)
    docs = make([(i, " ".join(["often"] * 30 + [f"w{rng.randrange(10**6)}" for _ in range(100)])) for i in range(100)])
    found = word_codec.frequent_words(docs.coalesce(1), PATH, 5, 16)
    assert found[0] == "often"
    exact = word_codec.frequent_words(docs, PATH, 1)
    assert exact == ["often"]


def test_empty_table_and_other_columns(spark, make):
    docs = make([])
    name = word_codec.build(docs, PATH)
    assert word_codec.round_trips(docs, PATH, name).count() == 0
    wide = make([(1, "a cat")]).selectExpr("*", "1 AS ids", "'x' AS word", "2 AS n")
    assert word_codec.encode(wide, PATH, word_codec.build(wide, PATH)).first().ids == [320, 2368]
    rows = spark.createDataFrame([(1, None), (2, []), (3, [320, None, 60_000])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in word_codec.decode(rows, PATH).collect()} == {1: None, 2: "", 3: "a</w>"}
