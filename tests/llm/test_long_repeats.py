import hashlib
import random

import numpy as np
import pytest

from airlens.llm import long_repeats
from airlens.llm.queries import op7_suffix_array_dedup

DATA = "/root/testdata/sf0.001"


def brute(docs, length=100):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        out[i] = (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def result(rows):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows}


def test_whole_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    assert result(op7_suffix_array_dedup(spark, DATA).collect()) == brute(docs)


def soup(rng, n, letters="abcdefghijklmnop \n"):
    return "".join(rng.choice(letters) for _ in range(n))


def repeats(seed):
    """Passages of about the bound, in differing surroundings, overlapping, periodic and cut in characters."""
    rng = random.Random(seed)
    parts = [soup(rng, n) for n in (99, 100, 101, 130, 180, 400)] + ["é" * 70, "ab" * 90, "x" * 250, "äöü" * 60]
    docs = []
    for i in range(60):
        text = ""
        for _ in range(rng.randrange(4)):
            p = rng.choice(parts)
            a = rng.randrange(40) if rng.random() < 0.5 else 0
            text += soup(rng, rng.randrange(60)) + p[a : len(p) - (rng.randrange(40) if rng.random() < 0.5 else 0)]
        docs.append((i * 3, text + soup(rng, rng.randrange(20))))
    return docs


@pytest.mark.parametrize("heavy", [False, True])
def test_passages_in_differing_surroundings(spark, make, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(long_repeats, "_heavy", lambda docs, length: np.unique(np.concatenate([long_repeats.anchors(t.encode(), 100)[0] for _, t in repeats(3)])))
    docs = repeats(3)
    rng = random.Random(9)
    rng.shuffle(docs)
    assert result(long_repeats.without_repeats(make(docs).repartition(5)).collect()) == brute(docs)


def test_odd_rows(spark, make):
    assert long_repeats.without_repeats(make([])).count() == 0
    long = soup(random.Random(2), 300)
    docs = [(1, None), (2, ""), (3, "x" * 99), (4, long), (4, long), (5, long[:150]), (None, long[100:260])]
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in long_repeats.without_repeats(make(docs)).collect())
    first = long_repeats.without_repeats(make([d for d in docs if d[0] == 4 or d[0] is None])).collect()
    assert got == [(-1, 160, 0), (1, 0, 0), (2, 0, 0), (3, 99, 0), (4, 300, 160), (4, 300, 300), (5, 150, 150)]
    assert sorted(r.n_removed for r in first) == [0, 160, 300]


def test_trimmed_keeps_columns_and_whole_characters(spark, make):
    mid = soup(random.Random(5), 90, "üöäßé")
    rows = {r.doc_id: r for r in long_repeats.trimmed(make([(1, "start " + mid), (2, mid + " end"), (3, None)])).collect()}
    assert rows[1].text == "start " + mid and (rows[1].lang, rows[1].source) == ("en", "s")
    assert rows[2].text == " end" and rows[2].n_chars == 4 and rows[3].text == ""


def test_long_text_is_cut_into_slices(monkeypatch):
    rng = random.Random(1)
    data = soup(rng, 5000).encode()
    whole = long_repeats.anchors(data, 100)
    monkeypatch.setattr(long_repeats, "SLICE", 700)
    seed, first, last = long_repeats.anchors(data, 100)
    assert first[0] == 0 and last[-1] == len(data) - 100 and (first[1:] == last[:-1] + 1).all()
    covers = lambda f, s: np.repeat(s, np.diff(np.append(f, len(data) - 99)))
    assert (covers(first, seed) == covers(whole[1], whole[0])).all()


def test_levels_merge_geometrically():
    rng = np.random.default_rng(3)
    levels, seen = long_repeats.Levels(100), set()
    for _ in range(40):
        rows = rng.integers(97, 99, (50, 100), np.uint8)
        rows[:, 9:] = 97
        windows = rows.view("S100")[:, 0]
        want = []
        for w in windows.tolist():
            want.append(w in seen)
            seen.add(w)
        assert levels.add(windows).tolist() == want
    assert sum(map(len, levels.runs)) == len(seen) and len(levels.runs) < 8
