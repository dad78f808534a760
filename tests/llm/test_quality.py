import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from airlens.llm import language, quality_classifier, quality_rules
from airlens.llm.queries import op5_language_id, op9_quality_rules, op10_quality_classifier

DATA = "/root/testdata/sf0.001"
GOOD = """The ferry left the quay before dawn and few people saw it go.
Rain had fallen all night, so the decks were wet and the ropes swollen.
A boy sold hot tea from a can that his mother had wrapped in wool.
Nobody spoke much until the islands rose out of the haze at noon.
Then the captain rang a bell and everyone went up to look at the birds."""
ODD = [None, "", " \n\t", "x", "###", "word " * 400, "a\x00b ﬁ 日本語 é", " ".join(f"{w}{i}" for i in range(300) for w in GOOD.split())]


def brute_repeats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({i + j for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for j in range(8)})


def test_op9_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    got = op9_quality_rules(spark, DATA)
    want = con.execute(quality_rules.SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("text", [GOOD, GOOD * 2, "a b c d e f g h " * 3, "a b c d e f g h a b c d e f g h", "x y " * 30 + GOOD])
def test_repeated_words(text):
    assert quality_rules.repeated_words(text) == brute_repeats(text)


def test_lines_fail_alone():
    def ok(line):
        return quality_rules.passes(line, line.split())

    assert ok("A short one.") and ok("This line has more than seven words but lacks an ending")
    assert not ok("home products about") and not ok("ALL OF THIS IS SHOUTED AT YOU!")
    assert not ok("Home | Shop | News | Contact us today.") and not ok("some# words$ with* marks& at% their| ends<.")
    assert not ok("This site uses cookies to make it better for all.") and not ok("same same same same same same same.")


def test_verdicts_and_cleaned_text(make, spark):
    menu = "Home | Products | News | Contact"
    rows = [(1, f"{menu}\n{GOOD}\n{menu}"), (2, "\n".join([menu] * 1 + [f"Item {i} | {i} | x" for i in range(200)]) + "\n" + GOOD), (3, None), (4, GOOD), (4, GOOD), (None, GOOD)]
    got = Counter((r.doc_id, r.kept, r.cleaned) for r in quality_rules.quality(make(rows), with_text=True).collect())
    assert got[(1, True, GOOD)] == 1 and got[(4, True, GOOD)] == 2 and got[(None, True, GOOD)] == 1 and got[(3, False, "")] == 1
    assert [k for i, k, _ in got if i == 2] == [False]
    assert quality_rules.quality(make([])).count() == 0
    assert quality_rules.quality(make(list(enumerate(ODD)))).count() == len(ODD)


def test_op10_learns_and_keeps_labels_out(spark):
    got = {r.doc_id: r for r in op10_quality_classifier(spark, DATA).collect()}
    labels = spark.read.parquet(f"{DATA}/labels.parquet").collect()
    assert len(got) == 200
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    right = [got[r.doc_id].predicted == r.quality for r in labels if got[r.doc_id].held_out]
    assert np.mean(right) > 0.9


def test_op10_scores_ignore_other_columns_and_odd_rows(spark, make):
    docs = make([(i, GOOD if i % 2 else "### *** $$$ && || " * 30) for i in range(60)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(None, GOOD), (1, GOOD)])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(60)] + [(None, 1, 0), (1, 0, 0), (2, None, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).collect()
    assert len(got) == 60 + len(ODD) + 2
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 60)
    nothing = quality_classifier.train(docs, labels.where("false"))
    assert {r.score for r in quality_classifier.score(docs, nothing).collect()} == {0.5}
    assert quality_classifier.score(make([]), model).count() == 0


def test_dual_coordinate_descent_separates():
    rows = [np.array([i % 2, 2 + i % 5]) for i in range(50)]
    model = quality_classifier.fit(rows, np.array([i % 2 for i in range(50)]))
    assert all((model.margin(r) > 0) == i % 2 for i, r in enumerate(rows))


def test_op5_predicts_held_out_languages(spark):
    got = {r.doc_id: r for r in op5_language_id(spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(got) == len(docs)
    right = []
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.held_out:
            right.append(r.lang_pred == d.lang)
    assert np.mean(right) > 0.95


def test_op5_odd_rows(spark, make):
    docs = make([(i, t) for i, t in enumerate(ODD)] + [(None, GOOD), (50, GOOD), (50, GOOD)])
    got = language.identify(docs, language.train(docs)).collect()
    assert len(got) == len(ODD) + 3
    assert all((r.lang_pred == "und") == (r.doc_id in (0, 1, 2, 4)) for r in got)
    none = language.train(make([]))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(make([]), none).count() == 0


def test_one_product_equals_the_kernel_expansion():
    rng = np.random.default_rng(1)
    rows = rng.random((40, 1 << language.BITS)) < 0.01
    names = ["a" if i % 2 else "b" for i in range(40)]
    model = language.fit(rows, names, landmarks=12)
    own = rows[np.random.default_rng(3).permutation(40)[:12]]
    target = np.where(np.array(names)[:, None] == np.array(["a", "b"])[None, :], 1.0, -1.0)
    k_nm, k_mm = language.kernel(rows, own).astype(float), language.kernel(own, own).astype(float)
    dual = np.linalg.solve(k_nm.T @ k_nm + 1e-2 * 40 / 100 * k_mm + 1e-6 * np.eye(12), k_nm.T @ target)
    assert np.allclose(k_nm @ dual, model.margins(rows), atol=1e-3)


def test_phrases_in_prose_are_no_furniture():
    """A long article on one line may mention what page furniture says; short lines and lines full of it may not."""
    prose = "The students assign in class what they design in turn, and people read more books about one cookie or the catalog in print. "
    article = prose + " ".join(f"Sentence{i} tells{i} of something{i} else entirely{i}, in plain{i} words{i}." for i in range(60))
    assert quality_rules.judge(article)["lost_chars"] == 0 and quality_rules.judge(article)["kept"]
    for line in ("Click here.", "Copyright 2020 Somebody. All rights reserved.", "Licensed under the terms of a licence, see the file.", "Alle Rechte vorbehalten.", "Lire la suite.", "This site uses cookies."):
        assert not quality_rules.passes(line, line.split()), line
    for line in ("We design in the open and keep a catalog in the hall for whoever may want to look.", "Cookiecutters are sold here."):
        assert quality_rules.passes(line, line.split()), line
    links = " ".join(["Privacy policy, terms of use, log in."] * 4)
    assert quality_rules.furniture(links, len(links.split()))


def test_training_rows_do_not_depend_on_their_order(spark):
    """Repeated ids with other texts and languages, in three orders of the rows: one model each."""
    words = {"en": "the house and the garden", "de": "das haus und der garten", "fr": "la maison et le jardin"}
    rows = [(i, f"{words[g]} {i} {k}", g) for i in range(60) for k, g in enumerate(("en", "de", "fr")[: 1 + i % 3])]
    quality = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    found = set()
    for seed in range(3):
        np.random.default_rng(seed).shuffle(rows)
        docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(seed + 1)
        model = language.train(docs)
        scores = quality_classifier.score(docs, quality_classifier.train(docs, quality)).orderBy("doc_id", "score").collect()
        found.add((tuple(model.languages), model.weight.tobytes(), tuple(r.score for r in scores)))
    assert len(found) == 1
