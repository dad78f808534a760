"""One text of about a million characters beside short ones: whole through each operator, without a special case."""

import random

import public_tokenizers
import pytest

from airlens.llm import fingerprints, language, language_model, near_dup, packing, quality_classifier, quality_rules, word_bpe

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(41)
    vocabulary = ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randint(3, 9))) for _ in range(30_000)]
    return " ".join(rng.choice(vocabulary) + ("." if i % 17 == 0 else "") for i in range(160_000))


@pytest.fixture()
def docs(make, long_text):
    return make([(1, long_text), (2, long_text + " one more"), (3, "a short text"), (4, None), (5, "")])


def test_near_duplicates(docs):
    got = {r.doc_id: (r.component_id, r.n_shingles) for r in near_dup.near_duplicates(docs, size=4).collect()}
    assert got[1][0] == got[2][0] == 1 and got[2][1] - got[1][1] == 2 and got[3] == (3, 1) and got[4] == (4, 0)


def test_packing_cuts_only_long_documents(docs):
    pieces = packing.pack(docs, WORDS, 2048).collect()
    sizes = {}
    for p in pieces:
        sizes.setdefault(p.doc_id, []).append((p.piece, p.start, p.length))
    for doc_id, n in {r.doc_id: r.n_tokens for r in word_bpe.count_tokens(docs, WORDS).collect()}.items():
        at = 0
        for number, (piece, start, length) in enumerate(sorted(sizes[doc_id])):
            assert (piece, start) == (number, at) and length == min(2048, n + 1 - at)
            at += length
        assert at == n + 1


def test_rules_languages_quality_and_scores(docs, spark, long_text):
    rules = {r.doc_id: r for r in quality_rules.quality(docs).collect()}
    assert rules[1].n_words == 160_000 and rules[1].word_chars == len(long_text.replace(" ", ""))
    learn = spark.createDataFrame([(i, f"{w} {i}", g) for i in range(20) for g, w in (("en", "the house"), ("de", "das haus"))], "doc_id bigint, text string, lang string")
    assert language.identify(docs, language.train(learn)).count() == 5
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    assert all(0 <= r.score <= 1 for r in quality_classifier.score(docs, quality_classifier.train(learn, labels)).collect())
    scores = {r.doc_id: r for r in language_model.pseudo_likelihood(docs, *language_model.train(docs)).collect()}
    assert scores[1].n_tokens == 160_000 and scores[2].n_tokens == 160_002 and scores[1].log_likelihood < 0


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert got[2].near_next > 0.999 and got[1].n_chars > 900_000 and got[1].fingerprint
