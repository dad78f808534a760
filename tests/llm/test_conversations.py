"""Repair of conversations against a search over all edits, and against the same rows dealt otherwise."""

import hashlib
import random
import zlib

import pytest

from airlens.llm import conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACES)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """``(cost, audit, repaired)``: every way through the rows, with up to three inserts between two of them."""
    marks = faults(rows)
    best = {}

    def ways(i, state):
        """Least (cost, audit, repaired) from row i on: by definition, not by numbers."""
        if (i, state) not in best:
            found = []
            for inserted in range(4):
                at, new = state, []
                for _ in range(inserted):
                    new.append("assistant:" if at == 2 else "user:")
                    at = 3 if at == 2 else 2
                head = (2 * inserted, "I" * inserted, new)
                if i == len(rows):
                    if at in (0, 3):
                        found.append(head)
                    continue
                role, text = rows[i]
                options = [(3, "D", [], at)]
                if marks[i] not in ("blank", "duplicate"):
                    extra = int(marks[i] == "truncated")
                    to = {"s": 1 if at == 0 else None, "u": 2 if at != 2 else None, "a": 3 if at == 2 else None}.get(role[:1])
                    if to is not None:
                        options.append((extra, "K", [f"{role}:{text}"], to))
                    options.append((2 + extra, "R", [f"{'assistant' if at == 2 else 'user'}:{text}"], 3 if at == 2 else 2))
                for cost, letter, kept, to in options:
                    rest = ways(i + 1, to)
                    if rest is not None:
                        found.append((head[0] + cost + rest[0], head[1] + letter + rest[1], head[2] + kept + rest[2]))
            best[i, state] = min(found, default=None)
        return best[i, state]

    return ways(0, 0)


def expected(rows, original):
    """Contract's row of one conversation from its rows ``(turn, role, text)`` in order."""
    pairs = [(r, t) for _, r, t in rows]
    marks = faults(pairs)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, repaired = brute(pairs) if pairs else (0, "", [])
    initials = [r[:1] for r, _ in pairs]
    return {
        "conv_id": original,
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        "blank": marks.count("blank"),
        "duplicate": marks.count("duplicate"),
        "truncated": marks.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
        "cost": cost,
        "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(repaired).encode()).hexdigest(),
    }


def ordered(rows):
    rows = [(t, " " if r is None else r, " " if x is None else x) for _, t, r, x in rows]
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.translate({ord(c): None for c in ".!?"})
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def compare(got, rows, ids):
    want = [expected(ordered([r for r in rows if r[0] == i]), i) for i in ids]
    order = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0)
    assert sorted((r.asDict() for r in got.collect()), key=order) == sorted(want, key=order)


def invented(seed, conversations_, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations_):
        for turn in range(rng.randint(1, longest)):
            text = rng.choice(["Yes.", "No", "", " \t", "Why?", f"Line {turn}.", f"Line {turn}"])
            rows.append((conv, rng.choice([turn, turn, None, turn // 2]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), rng.choice([text, text, None])))
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_repair_is_least_over_all_edits(spark, parts):
    rows = invented(1, 60, 12) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Lo")]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = conversations.repair(spark.createDataFrame(rows, SCHEMA))
        compare(got, rows, {r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_a_long_conversation_spans_tasks_and_blocks(spark, monkeypatch):
    """Most rows in one conversation: pieces of many tasks, blocks inside, the same edits as in one."""
    rng = random.Random(2)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{t}.", f"{t}", "same.", ""])) for t in range(700)] + invented(3, 5, 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", 9)
    try:
        pieces = conversations.edited(spark.createDataFrame(rows, SCHEMA))
        assert pieces.where("conv_id = 5").count() > 3
        compare(conversations.digests(pieces), rows, {r[0] for r in rows})
        done = conversations.edits(pieces).where("conv_id = 5").orderBy("part", "place").collect()
        want = expected(ordered([r for r in rows if r[0] == 5]), 5)
        assert "".join(r.edit for r in done) == want["audit"]
        text = "\n".join(f"{r.role}:{r.text}" for r in done if r.edit != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == want["repaired_sha256"]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_damaged_rows_and_conversations_that_vanish(spark):
    rows = [(c, t, r, x) for c in range(150) for t, r, x in [(0, "user", "What? Now!"), (1, "assistant", "This."), (None, None, None)][: 1 + c % 3]]
    table = spark.createDataFrame(rows, SCHEMA)
    hurt = damage(rows)
    assert len({r[0] for r in hurt}) < 150
    compare(conversations.repair(conversations.damaged(table), table), hurt, {r[0] for r in rows})


def test_many_equal_rows_count_once_and_are_deleted(spark):
    rows = [(1, 4, "user", "Again.")] * 500 + [(1, 5, "assistant", "Yes.")]
    compare(conversations.repair(spark.createDataFrame(rows, SCHEMA)), rows, {1})


def test_empty_table_long_text_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty), empty).count() == 0
    rows = [(1, 0, "user", "long " * 300_000 + "."), (1, 1, "assistant", "Yes.")]
    wide = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, copies int").withColumnRenamed("digest", "part")
    compare(conversations.repair(wide), rows, {1})


def test_legal_conversations_stay_as_they_are(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello.")]
    got = conversations.repair(spark.createDataFrame(rows, SCHEMA)).first()
    assert (got.cost, got.audit, got.illegal) == (0, "KKK", 0)


def test_sql_gives_the_same_on_odd_rows(spark, tmp_path):
    import duckdb

    rows = invented(7, 120, 9) + [(None, 3, "user", "Hm"), (None, None, None, None)]
    table = spark.createDataFrame(rows, SCHEMA)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = con.execute(conversations.SQL)
    names = [d[0] for d in cursor.description]
    want = [dict(zip(names, r)) for r in cursor.fetchall()]
    order = lambda r: (r["conv_id"] is not None, r["conv_id"] or 0)
    got = [r.asDict() for r in conversations.repair(conversations.damaged(table), table).collect()]
    assert sorted(got, key=order) == sorted(want, key=order)
