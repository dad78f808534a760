"""Repair of conversations: the cheapest edits that make a legal order of roles, by an integer shortest path.

Legal orders of role initials are ``(s?(ua)+)?``. Four states read them: 0 before all (legal end), 1 after ``s``, 2 after
``u``, 3 after ``a`` (legal end). Edits are letters: Delete 3, Insert of an empty user or assistant row 2, Keep 0, Rerole
to user or assistant 2; a truncated row that is not deleted costs 1 more, blank and repeated rows must be deleted.

A way through a block of rows is one whole number: its high digits are the cost, its low digits the letters of its edits,
three bits each, first letter first, with zeros behind the last one. Letters are numbered in ASCII order, so the smaller
number is the cheaper way or, at equal cost, the one whose audit is less; the minimum of ordinary integers decides all.
Numbers are built from the last row back: a letter before a way moves the way's digits one place on.

Rows are dealt by range over (conversation, turn, role, text), so a conversation of any share of all rows spans many tasks.
Each task cuts its rows into blocks and joins their 4 x 4 tables of least numbers in a tree. A conversation inside one task
ends there; of the others, tables (16 numbers a task) meet by conversation, and each task's states are handed back down.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from airlens.llm import work

#: Fixed values of the repair rule: letters in ASCII order, costs, places in the order of roles.
LETTERS = "\0DIKR"
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
READS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = {0: "user", 1: "user", 2: "assistant", 3: "user"}
LEGAL_ENDS = (0, 3)
LEGAL_PAIRS = frozenset({"su", "ua", "au"})
BITS = 3
BLOCK = 96

GOOD, BLANK, DUPLICATE, TRUNCATED = range(4)
_SPACES = " \t\n\x0b\x0c\r"

_FIELDS = ("turn", "role", "text", "fault", "copies")
ROW = "struct<turn:bigint, role:string, text:string, fault:int, copies:bigint>"
_PIECES = (
    "conv_id bigint, part int, closed boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, head string, tail string,"
    f" least_turn bigint, most_turn bigint, turns bigint, rows array<{ROW}>, table binary, state int, letters string, cost bigint"
)
_DIGEST = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"


class Way:
    """Least numbers between states: ``at[p][q]`` is the number of the best way from p to q, or None."""

    __slots__ = ("at", "width")

    def __init__(self, at: list, width: int):
        self.at, self.width = at, width

    def cost(self, number: int) -> int:
        return number >> BITS * self.width

    def letters(self, number: int) -> str:
        digits = number & ((1 << BITS * self.width) - 1)
        text = "".join(LETTERS[int(c)] for c in format(digits, f"0{self.width}o")) if self.width else ""
        return text.rstrip("\0")


def _block(rows: list[tuple]) -> Way:
    """Table of one block of ``(role initial, fault)``, from its last row back."""
    width = 3 * len(rows) + 2
    top, cost_at = BITS * (width - 1), BITS * width
    mask = (1 << cost_at) - 1
    first = {letter: letter << top for letter in COST}

    def before(letter: int, extra: int, number: int) -> int:
        return (((number >> cost_at) + COST[letter] + extra) << cost_at) | first[letter] | ((number & mask) >> BITS)

    columns = []
    for end in range(4):
        value: list = [0 if q == end else None for q in range(4)]
        for initial, fault in reversed(rows):
            extra = int(fault == TRUNCATED)
            must_go = fault in (BLANK, DUPLICATE)
            here: list = []
            for q in range(4):
                found = [] if value[q] is None else [before(DELETE, 0, value[q])]
                if not must_go:
                    kept = READS.get((q, initial))
                    if kept is not None and value[kept] is not None:
                        found.append(before(KEEP, extra, value[kept]))
                    forced = READS[q, WANTED[q][0]]
                    if value[forced] is not None:
                        found.append(before(REROLE, extra, value[forced]))
                here.append(min(found, default=None))
            for _ in range(2):  # rows may be inserted before this one; after two the states repeat
                for q in range(4):
                    then = here[READS[q, WANTED[q][0]]]
                    if then is not None:
                        way = before(INSERT, 0, then)
                        here[q] = way if here[q] is None else min(here[q], way)
            value = here
        columns.append(value)
    return Way([[columns[q][p] for q in range(4)] for p in range(4)], width)


def _end() -> Way:
    """Inserts behind the last row, up to a legal end; its second state is 0 for every legal end."""
    at: list = [[None] * 4 for _ in range(4)]
    for p in range(4):
        q, number, place = p, 0, 1
        while q not in LEGAL_ENDS:
            number = number + (COST[INSERT] << BITS * 2) + (INSERT << BITS * place)
            q, place = READS[q, WANTED[q][0]], place - 1
        at[p][0] = number
    return Way(at, 2)


def _join(a: Way, b: Way) -> Way:
    """``a`` then ``b``: the second way's digits follow the first's last letter."""
    width = a.width + b.width
    a_bits, b_bits = BITS * a.width, BITS * b.width
    a_mask, b_mask = (1 << a_bits) - 1, (1 << b_bits) - 1
    at: list = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for s in range(4):
            x = a.at[p][s]
            if x is None:
                continue
            digits = x & a_mask
            used = a.width - ((digits & -digits).bit_length() - 1) // BITS if digits else 0
            for q in range(4):
                y = b.at[s][q]
                if y is None:
                    continue
                cost = (x >> a_bits) + (y >> b_bits)
                way = (cost << BITS * width) | (digits << b_bits) | (((y & b_mask) << a_bits) >> BITS * used)
                if at[p][q] is None or way < at[p][q]:
                    at[p][q] = way
    return Way(at, width)


def _tree(ways: list[Way]) -> Way:
    if not ways:
        return Way([[0 if p == q else None for q in range(4)] for p in range(4)], 0)
    while len(ways) > 1:
        ways = [_join(*ways[i : i + 2]) if i + 1 < len(ways) else ways[i] for i in range(0, len(ways), 2)]
    return ways[0]


def _flat(rows: list[tuple]) -> list[tuple]:
    """``(initial, fault)`` of every row, copies written out."""
    out = []
    for _, role, _, fault, copies in rows:
        out.append((role[:1], fault))
        if copies > 1:
            out += [(role[:1], BLANK if fault == BLANK else DUPLICATE)] * (copies - 1)
    return out


def _tuples(rows: list[dict]) -> list[tuple]:
    return [tuple(r[n] for n in _FIELDS) for r in rows]


def table(rows: list[tuple]) -> Way:
    flat = _flat(rows)
    return _tree([_block(flat[i : i + BLOCK]) for i in range(0, len(flat), BLOCK)])


def applied(rows: list[tuple], letters: str, state: int) -> Iterator[tuple]:
    """``(edit, turn, role, text)`` for each letter; deleted rows keep turn and role, inserted ones have no turn."""
    source = ((r, k) for r in rows for k in range(r[4]))
    for letter in letters:
        if letter == "I":
            role = WANTED[state]
            state = READS[state, role[0]]
            yield letter, None, role, ""
            continue
        (turn, role, text, _, _), _ = next(source)
        if letter == "R":
            role = WANTED[state]
        if letter == "D":
            text = None
        else:
            state = READS[state, role[:1]]
        yield letter, turn, role, text


class _Segment:
    """What one task holds of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.rows = conv_id, []

    def facts(self) -> dict:
        flat = _flat(self.rows)
        turns = {r[0] for r in self.rows} - {None}
        count = [0] * 4
        for _, fault in flat:
            count[fault] += 1
        return {
            "blank": count[BLANK],
            "duplicate": count[DUPLICATE],
            "truncated": count[TRUNCATED],
            "illegal": sum(a[0] + b[0] not in LEGAL_PAIRS for a, b in zip(flat, flat[1:], strict=False)),
            "head": flat[0][0],
            "tail": flat[-1][0],
            "least_turn": min(turns, default=None),
            "most_turn": max(turns, default=None),
            "turns": len(turns),
        }


def _segments(batches: Iterator[pa.RecordBatch], kind: StructType) -> Iterator[pa.RecordBatch]:
    """A row for each conversation of the task's sorted rows; only the first and the last may go on in other tasks."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    part = TaskContext.get().partitionId()
    now: _Segment | None = None
    ready: list[dict] = []
    first = True

    def close(last: bool) -> None:
        nonlocal first
        if now is None:
            return
        whole, closed = table(now.rows), not first and not last
        out = {"conv_id": now.conv_id, "part": part, "closed": closed, "rows": [dict(zip(_FIELDS, r, strict=True)) for r in now.rows]} | now.facts()
        if closed:
            out["state"], out["letters"], out["cost"] = chosen([whole])[0]
        else:
            out["table"] = pickle.dumps((whole.at, whole.width))
        ready.append(out)
        first = False

    names = ("conv_id", "turn", "role", "text", "digest", "copies", "blank", "cut")
    held = None
    for batch in work.slices(batches):
        for conv_id, turn, role, text, digest, copies, blank, cut in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if now is None or conv_id != now.conv_id:
                close(False)
                now, held = _Segment(conv_id), None
            key = (turn, role, digest)
            if key == held:  # the first of its kind came with its text, this row tells how often it stands here
                now.rows[-1] = (*now.rows[-1][:4], copies)
            elif copies:
                now.rows.append((turn, role, None, BLANK if blank else DUPLICATE, copies))
            else:
                now.rows.append((turn, role, text, BLANK if blank else TRUNCATED if cut else GOOD, 1))
            held = key
        if len(ready) >= work.ROWS:
            yield pa.RecordBatch.from_pylist(ready, schema=arrow)
            ready = []
    close(True)
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema=arrow)


def _spaced(name: str):
    return F.coalesce(F.col(name), F.lit(" ")).alias(name)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Distinct rows in order, each first of its role and text with the text, each place with its number of copies."""
    plain = rows.select("conv_id", "turn", _spaced("role"), _spaced("text")).withColumn("digest", F.sha2("text", 256))
    bare = F.expr(f"trim(BOTH '{_SPACES}' FROM text)")
    blank = (bare == "").alias("blank")
    firsts = (
        plain.groupBy("conv_id", "role", "text", "digest")
        .agg(F.max(F.col("turn").isNull()).alias("any_null"), F.min("turn").alias("least"))
        .select("conv_id", F.when(~F.col("any_null"), F.col("least")).alias("turn"), "role", "text", "digest", F.lit(0).cast("long").alias("copies"), blank, (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    )
    places = plain.select("conv_id", "turn", "role", "digest", blank).groupBy("conv_id", "turn", "role", "digest", "blank").count()
    places = places.select("conv_id", "turn", "role", F.lit("").alias("text"), "digest", F.col("count").alias("copies"), "blank", F.lit(False).alias("cut"))
    return firsts.union(places).repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest", "copies")


def chosen(ways: list[Way]) -> list[tuple[int, str, int]]:
    """State before each table, letters and cost of its part of the best way from the start to a legal end."""
    tails = [_end()]
    for way in reversed(ways):
        tails.append(_join(way, tails[-1]))
    out, state = [], 0
    for way, then in zip(ways, tails[-2::-1], strict=True):
        found = []
        for q in range(4):
            if way.at[state][q] is not None:
                only = Way([[way.at[state][q] if (p, r) == (state, q) else None for r in range(4)] for p in range(4)], way.width)
                found.append((_join(only, then).at[state][0], q))
        q = min(found)[1]
        number = way.at[state][q]
        out.append((state, way.letters(number), way.cost(number)))
        state = q
    end = _end()
    state_before, letters, cost = out[-1]
    out[-1] = (state_before, letters + end.letters(end.at[state][0]), cost + end.cost(end.at[state][0]))
    return out


def edited(rows: DataFrame) -> DataFrame:
    """The conversations of ``rows(conv_id, turn, role, text)`` in pieces, each with the cheapest edits of its rows.

    One row a conversation and task: ``conv_id, part`` (a conversation's pieces in order), counts of faults, the piece's
    ``rows`` in order with their copies, the ``state`` before it, the ``letters`` and the ``cost`` of its edits. Written
    once, since the pieces hold for one dealing of the rows.

    Nulls in role and text are one space; rows of a null conv_id are one conversation; a null turn comes first. Rows of
    equal turns go by role, then by a hash of the text, so that equal rows are neighbours. A row whose role and text stood
    earlier is a duplicate, whatever its turn; a turn's gap or a repeated turn is no fault. A text of any length is one
    value. No rows: no pieces. Other columns are ignored.
    """
    kind = StructType.fromDDL(_PIECES)
    found = work.written(_sorted_rows(rows).mapInArrow(lambda batches: _segments(batches, kind), kind))

    def across(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        ways = chosen([Way(*pickle.loads(t)) for t in table.column("table").to_pylist()])
        state, letters, cost = zip(*ways, strict=True)
        return pa.table([table.column("conv_id"), table.column("part"), pa.array(state, pa.int32()), pa.array(letters, pa.string()), pa.array(cost, pa.int64())], names=["conv_id", "part", "state", "letters", "cost"])

    open_ = found.where(~F.col("closed"))
    ways = open_.select("conv_id", "part", "table").groupBy("conv_id").applyInArrow(across, "conv_id bigint, part int, state int, letters string, cost bigint")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part"))
    solved = open_.drop("state", "letters", "cost").alias("a").join(ways.alias("b"), same).select("a.*", "b.state", "b.letters", "b.cost")
    return found.where("closed").unionByName(solved).drop("table")


def edits(pieces: DataFrame) -> DataFrame:
    """``conv_id, part, place, edit, turn, role, text`` of every edit of ``edited``: the repaired conversations and what was
    deleted (``edit`` D, text null). Inserted rows have no turn. Order: ``part``, then ``place``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.to_pylist():
                done = list(applied(_tuples(piece["rows"]), piece["letters"], piece["state"]))
                edit, turn, role, text = zip(*done, strict=True) if done else ((), (), (), ())
                n = len(done)
                columns = [pa.array([piece["conv_id"]] * n, pa.int64()), pa.array([piece["part"]] * n, pa.int32()), pa.array(range(n), pa.int64()), pa.array(edit, pa.string()), pa.array(turn, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "part", "place", "edit", "turn", "role", "text"])

    return pieces.select("conv_id", "part", "state", "letters", "rows").mapInArrow(run, "conv_id bigint, part int, place bigint, edit string, turn bigint, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order: a piece is read, added and let go."""
    names = [n.split()[0] for n in _DIGEST.split(", ")]
    now, ready, sha, sent, least, most, letters = None, [], None, False, None, None, []

    def end() -> None:
        if now is not None:
            gaps = 0 if least is None else most - least + 1 - now.pop("turns")
            ready.append({n: now.get(n) for n in names} | {"gaps": gaps, "audit": "".join(letters), "repaired_sha256": sha.hexdigest()})

    def flush() -> pa.RecordBatch:
        types = {"conv_id": pa.int64(), "audit": pa.string(), "repaired_sha256": pa.string()}
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in ready], types.get(n, pa.int64())) for n in names], names=names)

    for batch in batches:
        for at in range(batch.num_rows):
            piece = batch.slice(at, 1).to_pylist()[0]
            if now is None or piece["conv_id"] != now["conv_id"]:
                end()
                now, sha, sent, letters = {"conv_id": piece["conv_id"], "turns": 0, "tail": None} | dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), hashlib.sha256(), False, []
                least = most = None
            for name in ("blank", "duplicate", "truncated", "illegal", "cost", "turns"):
                now[name] += piece[name]
            now["illegal"] += now["tail"] is not None and now["tail"] + piece["head"] not in LEGAL_PAIRS
            now["tail"] = piece["tail"]
            if piece["turns"]:
                now["turns"] -= most is not None and most == piece["least_turn"]
                least, most = piece["least_turn"] if least is None else least, piece["most_turn"]
            letters.append(piece["letters"])
            for edit, _, role, text in applied(_tuples(piece["rows"]), piece["letters"], piece["state"]):
                if edit != "D":
                    sha.update(work.raw(f"\n{role}:{text}" if sent else f"{role}:{text}"))
                    sent = True
        if len(ready) >= work.ROWS:
            yield flush()
            ready = []
    end()
    if ready:
        yield flush()


def digests(pieces: DataFrame) -> DataFrame:
    """One row a conversation of ``edited``: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256`` (``role:text`` of the rows that stay, newline-joined). The audit and the hash of a conversation are
    one value and one running sum by their nature; its pieces pass through one task one by one for them."""
    whole = pieces.where("closed").mapInArrow(_digests, _DIGEST)
    cut = pieces.where(~F.col("closed")).repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_digests, _DIGEST)
    return whole.union(cut)


def repair(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``digests(edited(rows))`` and, for each ``conv_id`` of ``ids`` without rows: zeros, empty audit, hash of nothing."""
    found = digests(edited(rows))
    if ids is None:
        return found
    every = ids.select(F.col("conv_id").alias("_every")).distinct()
    joined = every.join(found, F.col("_every").eqNullSafe(F.col("conv_id")), "left")
    values = [F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return joined.select(F.col("_every").alias("conv_id"), *values, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """``rows`` damaged by the crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops the row, 1 empties its text,
    2 takes ``[.!?]`` out, 3 repeats the row, 4 sets role user; the rest stays. For tests and for the registered query."""
    kind = F.crc32(F.concat(_spaced("conv_id_text"), F.lit(":"), _spaced("turn_text"))) % 20
    plain = rows.select("conv_id", "turn", _spaced("role"), _spaced("text"), F.col("conv_id").cast("string").alias("conv_id_text"), F.col("turn").cast("string").alias("turn_text")).withColumn("_kind", kind)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return plain.where("_kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


#: The registered query in SQL (damage, faults, edits): the least struct of (cost, audit) from the last row back.
SQL = r"""
WITH RECURSIVE source AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), numbered AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(8 * length(name)),
      lambda k: ((ascii(substr(name, CAST(k // 8 + 1 AS INT), 1)) >> CAST(k % 8 AS INT)) & 1)::BIGINT)),
    lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295) % 20 AS kind FROM source
), hurt AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM numbered, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)
), ranked AS (
  SELECT *, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n FROM hurt
), marked AS (
  SELECT *, CASE WHEN bare = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair
  FROM ranked
), step AS (
  SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)) t(p, initial, q)
), gap AS (
  SELECT p, q, least_inserts, added FROM (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []),
    (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']),
    (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])) t(p, q, least_inserts, added)
), way AS (
  SELECT conv_id, n + 1 AS i, p,
    min({'cost': 2 * least_inserts, 'audit': repeat('I', least_inserts), 'lines': added}) AS best
  FROM (SELECT DISTINCT conv_id, n FROM marked), gap WHERE q IN (0, 3) GROUP BY conv_id, n, p
  UNION ALL
  SELECT conv_id, i, p, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
    SELECT m.conv_id, m.i, g.p, 2 * g.least_inserts + e.cost + w.best.cost AS cost,
      repeat('I', g.least_inserts) || e.letter || w.best.audit AS audit, g.added || e.kept || w.best.lines AS lines
    FROM way w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i - 1
    JOIN (
      SELECT NULL AS x, g0.q AS at, g0.q AS q, 'D' AS letter, 0 AS k FROM (SELECT DISTINCT q FROM gap) g0
      UNION ALL SELECT initial, p, q, 'K', 0 FROM step
      UNION ALL SELECT NULL, p, q, 'R', 0 FROM step WHERE initial <> 's') o
      ON o.q = w.p AND (o.letter = 'D' OR m.fault NOT IN ('blank', 'duplicate') AND (o.letter = 'R' OR o.x = left(m.role, 1)))
    JOIN gap g ON g.q = o.at,
    LATERAL (SELECT o.letter AS letter,
      CASE o.letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN o.letter <> 'D' AND m.fault = 'truncated' THEN 1 ELSE 0 END AS cost,
      CASE o.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [m.role || ':' || m.text]
        ELSE [CASE o.at WHEN 2 THEN 'assistant:' ELSE 'user:' END || m.text] END AS kept) e
  ) GROUP BY conv_id, i, p
), facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(f.gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(f.blank, 0) AS BIGINT) AS blank,
  CAST(coalesce(f.duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(f.truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(f.illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(w.best.cost, 0) AS BIGINT) AS cost,
  coalesce(w.best.audit, '') AS audit, sha256(coalesce(array_to_string(w.best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN way w ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = 1 AND w.p = 0
"""
