import hashlib
from collections import defaultdict

import numpy as np

from airlens.llm import fingerprints as fp
from airlens.llm.queries import op6_closed_syncmers
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def edited(docs):
    """doc_id -> edited text, by the definition."""
    order = sorted(docs, key=lambda d: -d[0])
    out = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        cut = len(t) // 3
        out[i] = t[: len(t) - cut] + after[:cut]
    return out


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = op6_closed_syncmers(spark, DATA).collect()
    want = edited(docs)
    assert len(rows) == len(docs)
    texts, prints = dict(docs), defaultdict(set)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints[texts[r.doc_id]].add(r.fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    assert np.mean([r.near_edited > 0.3 for r in rows]) > 0.95
    assert np.mean([r.near_edited > r.near_next for r in rows if texts[r.doc_id] != want[r.doc_id]]) > 0.97
    assert len(prints) == len({next(iter(v)) for v in prints.values()})


def test_fingerprint_of_edited_text_is_that_of_the_text(spark, make):
    docs = [(i, t) for i, t in enumerate(["", "a", "ab", "Ein kürzerer Text, öfter geschrieben.", "x" * 700, " ".join(f"w{j % 17}" for j in range(500)), None])]
    want = edited(docs)
    rows = {r.doc_id: r for r in fp.fingerprints(make(docs)).collect()}
    again = {r.doc_id: r for r in fp.fingerprints(make(list(want.items()))).collect()}
    for i in want:
        assert rows[i].edited_fingerprint == again[i].fingerprint
        assert rows[i].edited_sha256 == hashlib.sha256(want[i].encode()).hexdigest()
    assert 0 < rows[4].near_edited < 1 and rows[5].near_edited > 0.3 and rows[0].near_edited == 1.0


def test_empty_single_repeated_and_null_ids(spark, make):
    assert fp.fingerprints(make([])).count() == 0
    one = fp.fingerprints(make([(5, "alone here")])).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"alone halo").hexdigest()
    rows = fp.fingerprints(make([(1, "same"), (1, "same"), (1, "other text"), (None, "no id"), (2, None)])).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in rows) == [(0, 5), (1, 4), (1, 4), (1, 10), (2, 0)]


def test_closed_syncmers_against_brute_force(spark):
    values = [int(x) for x in np.random.default_rng(4).integers(0, 1000, 200)]
    got = spark.createDataFrame([(values,)], "v array<bigint>").select(fp._closed(F.col("v"), 4).alias("c")).first().c
    chosen = [i for i in range(len(values) - 4) if min(values[i], values[i + 4]) <= min(values[i + 1 : i + 4])]
    assert len(got) == len(chosen)
    want = spark.createDataFrame([(values[i], values[i + 2], values[i + 4]) for i in chosen], "a bigint, b bigint, c bigint").select(F.xxhash64("a", "b", "c")).collect()
    assert got == [r[0] for r in want]


def test_every_anchor_and_its_place_count(spark):
    """One word changed anywhere in a long text shows in its fingerprint; a moved start does not part matches, new gaps do."""
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 5000, 4000)]
    variants = [base] + [[*base[:i], "changed", *base[i + 1 :]] for i in range(100, 4000, 97)]
    variants += [["new"] * 50 + base, [w for i, w in enumerate(base) for w in ([w, "gap"] if i % 12 == 11 else [w])]]
    df = spark.createDataFrame([(i, " ".join(v)) for i, v in enumerate(variants)], "id long, text string")
    made = fp.sketched(df, "text", "s").select("id", "s", fp.as_text(F.col("s")).alias("f"), F.size("s.words").alias("n"), fp.links(F.col("s")).alias("l")).cache()
    assert made.select("f").distinct().count() == len(variants)
    assert made.where("id = 0").first().n > 1000
    first = made.where("id = 0").select(F.col("l").alias("l0"))
    near = {r.id: r.near for r in made.join(first).select("id", fp.likeness(F.col("l"), F.col("l0")).alias("near")).collect()}
    moved, gaps = near[len(variants) - 2], near[len(variants) - 1]
    assert near[0] == 1 and min(near[i] for i in range(1, len(variants) - 2)) > 0.98 and moved > 0.97 and gaps < 0.7


def test_no_size_parts_two_texts(spark, make):
    """Texts of very different lengths share the part of words, and likeness follows from the returned links."""
    words = [f"word{i}" for i in range(400)]
    whole = " ".join(words)
    docs = make([(2, whole[:90]), (1, whole[:410])])
    rows = {r.doc_id: r for r in fp.fingerprints(docs, with_links=True).collect()}
    assert rows[2].near_next > 0
    links = {i: set(r.links.words) for i, r in rows.items()}
    assert len(links[2] & links[1]) / len(links[2] | links[1]) <= rows[2].near_next
    assert rows[2].links.words and rows[1].links.words
