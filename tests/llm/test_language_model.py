import random

import numpy as np
import pytest

from airlens.llm import language_model as lm
from airlens.llm.queries import op3_lm_scoring

DATA = "/root/testdata/sf0.001"


def test_gradients_are_those_of_the_loss():
    net = lm.Net.start()
    rng = np.random.default_rng(2)
    around, token = rng.integers(0, 1025, (64, 4)), rng.integers(0, 1024, 64)
    before = net.log_probability(around, token).mean()
    for _ in range(60):
        net.train(around, token)
    assert net.log_probability(around, token).mean() > before + 1


def test_probabilities_sum_to_one():
    net = lm.Net.start()
    around = np.tile(np.array([[1, 2, 3, 1024]]), (1024, 1))
    assert np.exp(net.log_probability(around, np.arange(1024))).sum() == pytest.approx(1, abs=1e-4)


def test_weights_survive_flattening():
    net = lm.Net.start()
    assert all((getattr(lm.Net.of(net.flat()), f) == getattr(net, f)).all() for f in ("vectors", "inner", "given", "low_bias"))


def test_op3_on_the_table(spark):
    rows = {r.doc_id: r for r in op3_lm_scoring(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        r = rows[d.doc_id]
        assert r.n_tokens == len(d.text.encode().split()) and (r.log_likelihood < 0 or not r.n_tokens)


def test_training_helps_and_order_counts(spark, make):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    sentence = lambda: " ".join(words[(s + i) % 40] for s in [rng.randrange(40)] for i in range(60))
    docs = make([(i, sentence()) for i in range(300)])
    weights = lm.train(docs, rounds=8)
    shuffled = sentence().split()
    rng.shuffle(shuffled)
    test = make([(1, sentence()), (2, " ".join(shuffled)), (3, None), (4, " \n"), (1, "w1 " * 40000), (None, "w1 w2")])
    trained = {(r.doc_id, r.n_tokens): r for r in lm.pseudo_likelihood(test, *weights).collect()}
    fresh = {(r.doc_id, r.n_tokens): r for r in lm.pseudo_likelihood(test, weights[0], lm.Net.start().flat()).collect()}
    assert trained[1, 60].log_likelihood > fresh[1, 60].log_likelihood
    assert trained[1, 60].log_likelihood > trained[2, 60].log_likelihood
    assert trained[3, 0].log_likelihood == 0 and trained[4, 0].mean_log_likelihood is None and len(trained) == 6


def test_slices_equal_the_whole(spark, make):
    text = " ".join(random.Random(3).choice(["a", "b", "c"]) for _ in range(40000))
    net = lm.Net.start()
    tokens = lm.Tokens([b"a", b"b", b"c"])
    t = tokens.of(text)
    want = net.log_probability(lm.windows(t), t).sum(dtype=np.float64)
    got = lm.pseudo_likelihood(make([(1, text)]), [b"a", b"b", b"c"], net.flat()).first().log_likelihood
    assert got == pytest.approx(want, rel=1e-5)


def test_frequent_words_cover_all_rows(spark, make):
    assert lm.frequent_words(make([(1, "b a A c"), (2, "b B b"), (3, None)]), 2) == [b"b", b"a"]
    assert lm.pseudo_likelihood(make([]), *lm.train(make([]))).count() == 0


def test_every_word_has_its_own_probability(spark, make):
    """Words of one class differ by their counts, near or looked up; the class's words and an unknown one sum to the class."""
    common = [f"c{i:03d}" for i in range(lm.FREQUENT)]
    rare = {"thrombus": 5, "throng": 3, "thrush": 2, "thrxqz": 1}
    corpus = make([(i, " ".join(common)) for i in range(9)] + [(9, " ".join(w for w, n in rare.items() for _ in range(n)))])
    words, counts = lm.frequent_words(corpus), lm.word_counts(corpus)
    assert words == [w.encode() for w in common]
    tests = make([(i, w) for i, w in enumerate([*rare, "thrnever"])] + [(9, "c001")])
    alone = lm.Net.start().log_probability(lm.windows(lm.Tokens(words).of("thrombus")), lm.Tokens(words).of("thrombus"))[0]
    for near in (0, 641, 1 << 17):
        got = {r.doc_id: r.log_likelihood for r in lm.pseudo_likelihood(tests, words, lm.Net.start().flat(), counts, near).collect()}
        assert [np.exp(got[i] - alone) for i in range(5)] == pytest.approx([5 / 12, 3 / 12, 2 / 12, 1 / 12, 1 / 12], rel=1e-5)
        assert sum(np.exp(got[i] - alone) for i in range(5)) == pytest.approx(1, rel=1e-5)


def test_every_place_trains_once():
    for n in (1, 2, 5, 700):
        t = np.random.default_rng(n).integers(0, 1024, n)
        for rounds in (1, 2, 8):
            assert (sum(lm.masked(lm.windows(t), t, part, rounds).astype(int) for part in range(rounds)) == 1).all()


def test_the_query_s_own_settings_learn(spark, make):
    """Held-out texts score better than their shuffled words, with the rounds that the query uses."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    sentence = lambda: [words[(s + i) % 40] for s in [rng.randrange(40)] for i in range(60)]
    model = lm.train(make([(i, " ".join(sentence())) for i in range(300)]))
    natural = [sentence() for _ in range(20)]
    tests = make([(i, " ".join(w)) for i, w in enumerate(natural)] + [(100 + i, " ".join(rng.sample(w, len(w)))) for i, w in enumerate(natural)])
    got = {r.doc_id: r.mean_log_likelihood for r in lm.pseudo_likelihood(tests, *model).collect()}
    assert all(got[i] > got[100 + i] for i in range(20)), (got[0], got[100])


def test_a_document_s_sum_from_the_definition(spark, make):
    """One word after the other: digits of its number from a network written out, times its share of its class."""
    rng = random.Random(31)
    common = [f"c{i:03d}" for i in range(lm.FREQUENT)]
    docs = make([(i, " ".join([*rng.sample(common, 40), *rng.choices(["rare", "rarer", "odd", "once" + str(i)], k=5)])) for i in range(60)] + [(99, " ".join(common * 3))])
    texts = lm.corpus(docs, near=700)
    weights = lm.fit(texts)
    got = {r.doc_id: r.log_likelihood for r in lm.scores(texts, weights).collect()}
    net, known = lm.Net.of(weights), {w: i for i, w in enumerate(texts.words)}
    counts = {bytes(r.word): r.n for r in texts.counts.collect()}
    number = lm.Tokens(texts.words)
    classes = {}
    for w, n in counts.items():
        if w not in known:
            t = int(number.of_words([w])[0])
            classes[t] = classes.get(t, 0) + n
    for doc_id, text in [(r.doc_id, r.text) for r in docs.where("doc_id < 5").collect()]:
        words = text.encode().split()
        t = [int(x) for x in number.of_words(words)]
        total = 0.0
        for i, w in enumerate(words):
            around = [t[j] if 0 <= j < len(t) else lm.SIDE**2 for j in (i - 2, i - 1, i + 1, i + 2)]
            h = np.tanh(np.concatenate([net.vectors[a] for a in around]).astype(float) @ net.inner + net.inner_bias)
            a = np.exp(h @ net.high + net.high_bias)
            b = np.exp(np.tanh(h + net.given[t[i] // lm.SIDE]) @ net.low + net.low_bias)
            total += np.log(a[t[i] // lm.SIDE] / a.sum()) + np.log(b[t[i] % lm.SIDE] / b.sum())
            total += 0.0 if w in known else np.log(counts[w] / (classes[t[i]] + 1))
        assert got[doc_id] == pytest.approx(total, rel=1e-5)


def test_short_texts_share_array_calls(monkeypatch):
    """Many short texts cost as many calls as their tokens need, not one each, and give what each gives alone."""
    rng = np.random.default_rng(7)
    texts = [rng.integers(0, 1024, n) for n in [0, *rng.integers(0, 40, 3000), lm.SPAN + 5, 0, 1, 0]]
    packed = [t.astype("<u2").tobytes() for t in texts]
    net, alone, calls = lm.Net.start(), lm.Net.log_probability, []
    want = [float(alone(net, lm.windows(t), t).sum(dtype=np.float64)) if len(t) else 0.0 for t in texts]
    monkeypatch.setattr(lm.Net, "log_probability", lambda self, *a: calls.append(1) or alone(self, *a))
    sums, sizes = lm.log_likelihoods(net, packed)
    assert sums == pytest.approx(want, rel=1e-5) and sizes.tolist() == [len(t) for t in texts]
    assert len(calls) <= sum(map(len, texts)) // lm.SLICE + 3
    for part in (0, 1):
        some = [(lm.windows(t), t) for t in texts if len(t)]
        spots = [lm.masked(a, t, part, 2) for a, t in some]
        chosen = [(row.around(at), row.values.take(at)) for row in lm.rows_of(packed) for at in [row.masked(part, 2)]]
        assert (np.concatenate([a for a, _ in chosen]) == np.concatenate([a[m] for (a, _), m in zip(some, spots, strict=True)])).all()
        assert (np.concatenate([t for _, t in chosen]) == np.concatenate([t[m] for (_, t), m in zip(some, spots, strict=True)])).all()
    assert [len(x) for x in lm.log_likelihoods(net, [])] == [0, 0]
