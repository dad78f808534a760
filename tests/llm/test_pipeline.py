import corpus_pipeline
from airlens.llm import quality_classifier, quality_rules
from airlens.llm.work import documents, labels, written
from test_long_repeats import brute as cut_repeats
from test_near_dup import brute as groups
from test_tokens import check_packing

DATA = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    """Each stage on what the one before it kept, against a plain version of it."""
    import hashlib

    docs = documents(spark, DATA)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, DATA))
        after = docs.collect()
        if name != "best-fit packing":
            assert docs.columns == columns
            assert all(r.n_chars == len(r.text) for r in after)
        if name == "quality rules":
            want = {r.doc_id: quality_rules.judge(r.text) for r in before}
            assert {r.doc_id: r.text for r in after} == {i: f["cleaned"] for i, f in want.items() if f["kept"]}
        elif name == "quality classifier":
            model = quality_classifier.train(spark.createDataFrame(before, docs.schema), labels(spark, DATA))
            assert {r.doc_id: r.text for r in after} == {r.doc_id: r.text for r in before if model.score(r.text) >= 0.5}
            quality = {r.doc_id: r.quality for r in labels(spark, DATA).collect()}
            assert all(quality.get(r.doc_id, 1) == 1 for r in after)
        elif name == "minhash near-dedup":
            kept = {i for i, v in groups([(r.doc_id, r.text) for r in before], 5, 80).items() if v[2]}
            assert {tuple(r) for r in after} == {tuple(r) for r in before if r.doc_id in kept}
        elif name == "suffix-array dedup":
            want = cut_repeats([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            changed = {i for i, v in want.items() if v[1]}
            assert {r.doc_id for r in after if r.text != {b.doc_id: b.text for b in before}[r.doc_id]} == changed
            whole = [r for r in after if hashlib.sha256(r.text.encode()).hexdigest() == want[r.doc_id][3]]
            assert len(whole) >= len(after) - len(changed)
        else:
            check_packing(after, [(r.doc_id, r.text) for r in before], 2048)


def test_stages_take_empty_odd_and_wider_tables(spark, make):
    odd = make([(1, None), (2, ""), (None, "one two"), (3, "x " * 50), (3, "x " * 50), (None, None)])
    for rows in (odd, odd.where("false")):
        wide = rows.selectExpr("*", "'a' AS kept", "1 AS bands", "2L AS id", "'k' AS digest")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, wide, DATA)
            assert out.count() >= 0
            if k < 4:
                assert set(rows.columns) <= set(out.columns)


def test_run_is_registered():
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    ops = {n.split("_")[0] for n in entry.queries() if n.startswith("op")}
    assert ops == {f"op{i}" for i in range(1, 14)}
