"""Ordered per-key analytics that stay parallel when one key holds most of the rows.

A plain window ``PARTITION BY key ORDER BY t`` puts a whole key into one task. ``scan`` gives the same
values in two levels instead. Rows are cut into chunks by ``t div span``; windows run inside
``(key, chunk)``, every chunk is reduced to one summary row (with map-side combine), a small window over the
summaries finds what each chunk inherits from the earlier ones, and a join on the same ``(key, chunk)``
hands that carry back. Both the window and the join use one shuffle of the rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SPAN = 1 << 18
CHUNK = "__chunk"


@dataclass(frozen=True)
class _Op:
    expr: Column

    def columns(self, x: Column, rows, within: Callable, order: list[str]) -> list:
        """Extra per-row columns that summary and local both read; a function makes one from the column before it.

        ``within(run)`` is a window over rows of the same chunk and run, still without an order.
        """
        return []

    def carries(self, df: DataFrame, s: str, c: str, chunks, within: Callable) -> DataFrame:
        return df.withColumn(c, self.carry(F.col(s), chunks))

    def summary(self, x: Column, at: Column) -> Column:
        raise NotImplementedError

    def carry(self, s: Column, chunks) -> Column:
        raise NotImplementedError

    def local(self, x: Column, rows) -> Column:
        raise NotImplementedError

    def merge(self, local: Column, carry: Column, first: Column, last: Column) -> Column:
        raise NotImplementedError


class Lag(_Op):
    """Value of the previous row of the key."""

    def summary(self, x, at):
        return F.max_by(x, at)

    def carry(self, s, chunks):
        return F.lag(s).over(chunks)

    def local(self, x, rows):
        return F.lag(x).over(rows)

    def merge(self, local, carry, first, last):
        return F.when(first, carry).otherwise(local)


class Lead(_Op):
    """Value of the next row of the key."""

    def summary(self, x, at):
        return F.min_by(x, at)

    def carry(self, s, chunks):
        return F.lead(s).over(chunks)

    def local(self, x, rows):
        return F.lead(x).over(rows)

    def merge(self, local, carry, first, last):
        return F.when(last, carry).otherwise(local)


class RunningSum(_Op):
    """Sum up to and including the row; nulls count as nothing."""

    def summary(self, x, at):
        return F.sum(x)

    def carry(self, s, chunks):
        return F.sum(s).over(chunks.rowsBetween(Window.unboundedPreceding, -1))

    def local(self, x, rows):
        return F.sum(x).over(rows.rowsBetween(Window.unboundedPreceding, 0))

    def merge(self, local, carry, first, last):
        zero = F.lit(0).cast("bigint")
        return F.coalesce(local, zero) + F.coalesce(carry, zero)


@dataclass(frozen=True)
class StepSum(_Op):
    """Running sum of ``step(x, previous x)``, starting from ``start(x)`` at the first row of the key.

    Fuses a lag and a sum into one pass: only the step across a chunk border needs the carry.
    """

    step: Callable[[Column, Column], Column]
    start: Callable[[Column], Column]

    def columns(self, x, rows, within, order):
        inner = self.step(x, F.lag(x).over(rows)).cast("bigint")
        return [F.when(F.lag(F.lit(1)).over(rows).isNotNull(), inner)]

    def summary(self, x, at, p):
        return F.struct(
            F.min_by(x, at).alias("head"), F.max_by(x, at).alias("tail"), F.coalesce(F.sum(p), F.lit(0).cast("bigint")).alias("inner")
        )

    def carries(self, df, s, c, chunks, within):
        head, before = F.col(f"{s}.head"), F.lag(F.col(f"{s}.tail")).over(chunks)
        border = F.when(F.lag(F.lit(1)).over(chunks).isNotNull(), self.step(head, before)).otherwise(self.start(head)).cast("bigint")
        bordered = df.withColumn("__border", border)
        total = F.sum(F.col("__border") + F.col(f"{s}.inner")).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
        return bordered.withColumn(c, F.col("__border") + F.coalesce(total, F.lit(0).cast("bigint"))).drop("__border")

    def local(self, x, rows, p):
        return F.sum(p).over(rows.rowsBetween(Window.unboundedPreceding, 0))

    def merge(self, local, carry, first, last):
        return carry + F.coalesce(local, F.lit(0).cast("bigint"))


def changes(expr: Column, first: int = 0) -> StepSum:
    """Number of value changes so far: a run id. Nulls compare as equal values."""
    return StepSum(expr, lambda x, prev: (~x.eqNullSafe(prev)).cast("bigint"), lambda x: F.lit(first))


class PriorMax(_Op):
    """Largest value of the rows before this one."""

    def summary(self, x, at):
        return F.max(x)

    def carry(self, s, chunks):
        return F.max(s).over(chunks.rowsBetween(Window.unboundedPreceding, -1))

    def local(self, x, rows):
        return F.max(x).over(rows.rowsBetween(Window.unboundedPreceding, -1))

    def merge(self, local, carry, first, last):
        return F.greatest(local, carry)


class PriorMaxStruct(PriorMax):
    """``PriorMax`` over a struct, compared field by field from the left."""

    def merge(self, local, carry, first, last):
        return F.when(local.isNull() | (carry > local), carry).otherwise(local)


@dataclass(frozen=True)
class RunPriorMax(_Op):
    """Largest ``value`` of the rows before this one in its run of equal ``expr``; null for the first row of a run.

    A run count and a maximum in one pass: only the first run of a chunk needs the carry.
    """

    value: Column

    def columns(self, x, rows, within, order):
        starts = F.when(F.lag(F.lit(1)).over(rows).isNotNull() & ~x.eqNullSafe(F.lag(x).over(rows)), 1).otherwise(0)
        return [starts, lambda p: F.sum(p).over(rows.rowsBetween(Window.unboundedPreceding, 0)), lambda p: self.value]

    def summary(self, x, at, p, r, v):
        last = F.max(F.struct(r.alias("run"), v.alias("value")))
        return F.struct(F.min_by(x, at).alias("head"), F.max_by(x, at).alias("tail"), F.sum(p).alias("inner"), last.getField("value").alias("value"))

    def carries(self, df, s, c, chunks, within):
        before = F.lag(F.col(f"{s}.tail")).over(chunks)
        fresh = F.lag(F.lit(1)).over(chunks).isNull() | ~F.col(f"{s}.head").eqNullSafe(before)
        numbered = df.withColumn("__fresh", fresh).withColumn("__run", F.sum(F.col("__fresh").cast("bigint") + F.col(f"{s}.inner")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)))
        top = F.max(F.struct("__run", F.col(f"{s}.value").alias("value"))).over(chunks.rowsBetween(Window.unboundedPreceding, -1))
        return numbered.withColumn(c, F.when(~F.col("__fresh"), top.getField("value"))).drop("__fresh", "__run")

    def local(self, x, rows, p, r, v):
        top = F.max(F.struct(r.alias("run"), v.alias("value"))).over(rows.rowsBetween(Window.unboundedPreceding, -1))
        return F.struct((r == 0).alias("first_run"), F.when(top.getField("run") == r, top.getField("value")).alias("value"))

    def merge(self, local, carry, first, last):
        return F.when(local.getField("first_run"), F.greatest(local.getField("value"), carry)).otherwise(local.getField("value"))


@dataclass(frozen=True)
class SinceStart(_Op):
    """Sum of ``expr`` from the latest row with ``start`` on, that row included; before any start, from the first row."""

    start: Column

    def columns(self, x: Column, rows, within: Callable, order: list[str]) -> list:
        run = F.sum(F.coalesce(self.start, F.lit(False)).cast("int")).over(rows.rowsBetween(Window.unboundedPreceding, 0))
        # a run is a stretch of the chunk's rows: they need another sort, but no other exchange
        return [run, lambda r: F.sum(x).over(within(r).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))]

    def summary(self, x, at, r, s):
        return F.struct(F.max(r).alias("inner"), F.max_by(s, at).alias("value"))

    def carries(self, df, s, c, chunks, within):
        numbered = df.withColumn("__run", F.sum(F.col(f"{s}.inner")).over(chunks.rowsBetween(Window.unboundedPreceding, 0)))
        whole = F.sum(F.col(f"{s}.value")).over(within(F.col("__run")).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, 0))
        return numbered.withColumn("__whole", whole).withColumn(c, F.lag("__whole").over(chunks)).drop("__run", "__whole")

    def local(self, x, rows, r, s):
        return F.struct((r == 0).alias("first_run"), s.alias("value"))

    def merge(self, local, carry, first, last):
        zero = F.lit(0).cast("bigint")
        return local.getField("value") + F.when(local.getField("first_run"), F.coalesce(carry, zero)).otherwise(zero)


class LastKnown(_Op):
    """Last non-null value up to and including the row."""

    def summary(self, x, at):
        return F.max_by(x, F.when(x.isNotNull(), at))

    def carry(self, s, chunks):
        return F.last(s, ignorenulls=True).over(chunks.rowsBetween(Window.unboundedPreceding, -1))

    def local(self, x, rows):
        return F.last(x, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0))

    def merge(self, local, carry, first, last):
        return F.coalesce(local, carry)


class PriorKnown(LastKnown):
    """Last non-null value of the rows before this one."""

    def local(self, x, rows):
        return F.last(x, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, -1))


class First(_Op):
    """Value of the first row of the key."""

    def summary(self, x, at):
        return F.min_by(x, at)

    def carry(self, s, chunks):
        return F.first(s).over(chunks.rowsBetween(Window.unboundedPreceding, 0))

    def local(self, x, rows):
        return F.lit(None)

    def merge(self, local, carry, first, last):
        return carry


def scan(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    span: int = DEFAULT_SPAN,
    **columns: _Op,
) -> DataFrame:
    """Add one column per operator, each computed over the rows of ``keys`` in the order ``order``.

    ``order[0]`` must be an integer column (a packet number or a time in microseconds); it also picks the
    chunk, ``span`` units wide: choose it so that a chunk holds some 10^5 to 10^6 rows. ``order`` must be unique within
    a key for a repeatable result.
    """
    base = df.withColumn(CHUNK, F.expr(f"`{order[0]}` div {span}"))
    for name, op in columns.items():
        base = base.withColumn(f"__x_{name}", op.expr)
    rows = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    prepared = {}
    for name, op in columns.items():
        for i, extra in enumerate(op.columns(F.col(f"__x_{name}"), rows, lambda run: Window.partitionBy(*keys, CHUNK, run), order)):
            held = prepared.setdefault(name, [])
            base = base.withColumn(f"__p{i}_{name}", extra(held[-1]) if callable(extra) and not isinstance(extra, Column) else extra)
            held.append(F.col(f"__p{i}_{name}"))

    # one plain column keeps the summary a hash aggregate; a struct would need a sort
    at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    carries = base.groupBy(*keys, CHUNK).agg(
        *[op.summary(F.col(f"__x_{n}"), at, *prepared.get(n, [])).alias(f"__s_{n}") for n, op in columns.items()]
    )
    chunks = Window.partitionBy(*keys).orderBy(CHUNK)
    for name, op in columns.items():
        carries = op.carries(carries, f"__s_{name}", f"__c_{name}", chunks, lambda run: Window.partitionBy(*keys, run))
    carries = carries.select(*keys, CHUNK, *[f"__c_{name}" for name in columns])

    local = base.select(
        *df.columns,
        CHUNK,
        F.lag(F.lit(1)).over(rows).isNull().alias("__chunk_first"),
        F.lead(F.lit(1)).over(rows).isNull().alias("__chunk_last"),
        *[op.local(F.col(f"__x_{n}"), rows, *prepared.get(n, [])).alias(f"__l_{n}") for n, op in columns.items()],
    )
    merged = local.join(carries, [*keys, CHUNK], "left")
    kept = [c for c in df.columns if c not in columns]
    return merged.select(
        *kept,
        *[
            op.merge(F.col(f"__l_{name}"), F.col(f"__c_{name}"), F.col("__chunk_first"), F.col("__chunk_last")).alias(name)
            for name, op in columns.items()
        ],
    )


def row_number(df: DataFrame, keys: list[str], order: list[str], name: str = "rn", span: int = DEFAULT_SPAN) -> DataFrame:
    """1-based row number per key, chunked like ``scan``."""
    return scan(df, keys, order, span, **{name: RunningSum(F.lit(1).cast("bigint"))})


def asof_state(
    events: DataFrame,
    state: DataFrame,
    by: list[str],
    on: str,
    values: list[str],
    span: int = DEFAULT_SPAN,
) -> DataFrame:
    """Each event with the latest state row of the same key at or before it (JOIN-8).

    A state row at the same position as an event counts as earlier. Events before any state get nulls.
    ``on`` is an integer position; several state rows at one position keep the largest ``values`` struct.
    """
    latest = state.groupBy(*by, on).agg(F.max(F.struct(*values)).alias("__state"))
    marked = events.withColumn("__state", F.lit(None).cast(latest.schema["__state"].dataType)).withColumn("__event", F.lit(1))
    both = marked.unionByName(latest.withColumn("__event", F.lit(0)), allowMissingColumns=True)
    known = scan(both, by, [on, "__event"], span, __known=LastKnown(F.col("__state")))
    return known.filter("__event = 1").select(
        *events.columns, *[F.col(f"__known.{v}").alias(v) for v in values]
    )


def first_n_per_group(df: DataFrame, keys: list[str], order: list[str], n: int, span: int = DEFAULT_SPAN) -> DataFrame:
    """Keep the first ``n`` rows of every group and report how many the group had beyond that (SRT-2)."""
    sizes = df.groupBy(*keys).agg(F.greatest(F.count(F.lit(1)) - F.lit(n), F.lit(0)).alias("overflow"))
    # row_number() <= n lets Spark prune to n rows per group before the shuffle (window group limit).
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    kept = df.withColumn("rank", rank).filter(F.col("rank") <= n)
    return kept.join(sizes, keys)
