"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates."""

from __future__ import annotations

import functools

import numpy as np
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airlens.llm import work
from airlens.llm.components import components

ROWS = 5
BANDS = 32
SKETCH_BITS = 1024
MORE_HUBS = 32


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's ``size``-word shingles, ASCII capitals lowered.

    Fewer words than ``size``: the whole sequence as one shingle. No words or no text: none.
    """
    h = work.hashes_of(work.words_of(work.raw(text).lower()))
    if 0 < len(h) < size:
        return work.windows_of(h, len(h)) ^ np.uint64(len(h))
    return np.unique(work.windows_of(h, size))


@functools.lru_cache(4)
def _borrow_order(bins: int) -> np.ndarray:
    """For each bin the order in which it asks the others for a value: itself first, then a random order of its own."""
    rng = np.random.default_rng(20170801)
    order = np.argsort(rng.random((bins, bins)), axis=1)
    order[order == np.arange(bins)[:, None]] = order[:, 0]
    order[:, 0] = np.arange(bins)
    return order


def sketch(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One value per bin: the smallest hash that falls there; an empty bin takes that of the first full one it asks.

    The order in which a bin asks is random and its own, so that copied values are independent (optimal densification).
    """
    edges = (np.arange(bins + 1, dtype=np.float64) * (2.0**64 / bins)).tolist()
    starts = np.searchsorted(hashes, np.array([min(int(e), 2**64 - 1) for e in edges[:-1]], np.uint64))
    ends = np.append(starts[1:], len(hashes))
    full = ends > starts
    values = hashes[np.minimum(starts, len(hashes) - 1)]
    if not full.all():
        order = _borrow_order(bins)
        values = values[order[np.arange(bins), full[order].argmax(axis=1)]]
    return values


def band_keys(hashes: np.ndarray, rows: int, bands: int) -> np.ndarray:
    values = sketch(hashes, rows * bands).reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * work.STEP
    for i in range(rows):
        out = work.mixed((out ^ values[:, i]) * work.GOLDEN)
    return out.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """1024 parities: how many elements fall on each bit, odd or even.

    Two sketches differ in at most as many bits as the sets differ in elements, so a pair whose sketches differ in more bits
    than two alike sets may is none, with certainty.
    """
    odd = np.bincount((hashes & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(docs: DataFrame, size: int, rows: int, bands: int) -> DataFrame:
    def run(ids, text_hashes, texts):
        digests, counts, keys, sketches = [], [], [], []
        for text in texts:
            s = shingles(text, size)
            digests.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            counts.append(len(s))
            keys.append(band_keys(s, rows, bands) if len(s) else None)
            sketches.append(odd_sketch(s) if len(s) else None)
        return {"doc_id": ids, "text_hash": text_hashes, "digest": digests, "n_shingles": counts, "bands": keys, "sketch": sketches}

    hashed = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id bigint, text_hash bigint, digest binary, n_shingles bigint, bands array<bigint>, sketch array<bigint>"
    return work.map_batches(hashed, run, schema, "doc_id", "text_hash", "text")


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` of classes whose full sets are alike enough. ``texts(class, packed)`` holds their texts."""

    def run(packed_a, packed_b, a, b):
        unpack = zstandard.ZstdDecompressor().decompress

        @functools.lru_cache(64)
        def of(packed):
            return shingles(unpack(packed).decode("utf-8", "surrogatepass"), size)

        alike = []
        for x, y in zip(packed_a, packed_b, strict=True):
            x, y = of(x), of(y)
            common = len(np.intersect1d(x, y, assume_unique=True))
            alike.append(100 * common >= percent * (len(x) + len(y) - common))
        return {"a": [v for v, k in zip(a, alike, strict=True) if k], "b": [v for v, k in zip(b, alike, strict=True) if k]}

    left, right = (texts.select(F.col("class").alias(c), F.col("packed").alias(f"packed_{c}")) for c in "ab")
    return work.map_batches(pairs.join(left, "a").join(right, "b"), run, "a bigint, b bigint", "packed_a", "packed_b", "a", "b")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, text_hash`` for every row of ``docs(doc_id, text)``.

    Two documents are linked when ``100 * common >= percent * all`` distinct shingles of ``size`` words; component_id is
    the smallest doc_id that links reach, and the document that bears it is kept.

    Rows with equal sets form one class, which is bucketed once. Each bucket compares its members with hubs only: one
    hub first, and where the members of a bucket are not all connected then, 32 times as many further hubs in each
    round, until every member is connected to the rest or was compared with it. So a bucket whose members are alike, the
    usual one, costs one pair a member, and no link between bucket mates is lost. A comparison first bounds the difference
    by parity sketches, in later rounds inside the join on buckets: only pairs that may be links leave it, so a large group
    of documents that are nearly, but not quite, alike makes no pairs either. Links are confirmed on full sets. Two
    documents at exactly 0.8 share no bucket with a probability of about 3e-6 (5 rows, 32 bands), more alike ones less.

    Null or empty text and text without words: no set, linked with nothing. Null doc_id: linked as others are, but it never
    names a component; alone, its component_id is null and it is kept. Repeated rows count as documents of that doc_id;
    all rows that bear the component's id are kept. Other columns are ignored.
    """
    signed = work.written(_signatures(docs, size, rows, bands))
    # A class is a number from here on: minima, groups and joins of numbers need no sort of bytes.
    classes = signed.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = work.written(classes.withColumn("class", F.monotonically_increasing_id()))
    sets = classes.select("class", "n", "sketch")
    members = classes.select("class", F.explode("bands").alias("bucket"))
    crowded = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").select("bucket")
    members = work.written(members.join(crowded, "bucket"))
    needed = classes.select("class", "digest").join(members.select("class").distinct(), "class")
    texts = work.written(_packed_texts(docs, signed, needed, size))

    # first round: one hub a bucket
    hub = members.groupBy("bucket").agg(F.min("class").alias("a"))
    starred = work.written(members.join(hub, "bucket"))
    pairs = starred.where("class <> a").select("a", F.col("class").alias("b")).distinct()
    pairs = work.written(_possible(pairs, sets, percent))
    links = done = None
    roots, hubs = None, 1
    state = starred.select("bucket", "class", F.col("class").alias("root"), (F.col("class") == F.col("a")).alias("hub"))
    while True:
        done = pairs if done is None else done.union(pairs)
        found = work.written(_confirm(pairs, texts, size, percent))
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            roots = components(links)
            state = (
                state.drop("root")
                .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
                .withColumn("root", F.coalesce("root", "class"))
            )
        state = _undecided(work.written(state))
        if hubs == 1:
            state = state.join(sets, "class")
        state = work.written(state)
        if state.isEmpty():
            break
        hubs *= MORE_HUBS
        pairs, state = _star(state, hubs, percent)
        pairs = work.written(pairs.join(done, ["a", "b"], "left_anti"))
    named = classes.select("digest", "class", "first_id")
    if roots is not None:
        named = named.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
        smallest = named.groupBy("root").agg(F.min("first_id").alias("component"))
        named = named.join(smallest, "root").select("digest", "component")
    else:
        named = named.select("digest", F.col("first_id").alias("component"))
    return signed.join(named, "digest", "left").select(
        "doc_id",
        "n_shingles",
        F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.col("component").isNull()).alias("kept"),
        "text_hash",
    )


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that bear the smallest doc_id of their component, one row for each; all columns stay.

    Rows without a doc_id take part under an id above all others that follows from their text. Rows equal in doc_id and text
    are one document. Other columns may have any names.
    """
    spare = F.xxhash64("text", F.lit(1)).bitwiseAND((1 << 61) - 1) + F.lit(1 << 62)
    own, hashed = work.unused("_id", docs.columns), work.unused("_hash", docs.columns)
    keyed = docs.withColumn(own, F.coalesce("doc_id", spare)).withColumn(hashed, F.xxhash64("text"))
    found = near_duplicates(keyed.select(F.col(own).alias("doc_id"), "text"), size, percent)
    kept = found.where("kept").select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed)).distinct()
    return keyed.join(kept, [own, hashed]).dropDuplicates([own, hashed]).select(*docs.columns)


def _packed_texts(docs: DataFrame, signed: DataFrame, needed: DataFrame, size: int) -> DataFrame:
    """``class, packed``: one compressed text of every class of ``needed(class, digest)``."""
    ids = signed.join(needed, "digest").groupBy("class", "digest").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("key"))
    keyed = docs.select(F.coalesce("doc_id", F.lit(-(1 << 62))).alias("key"), "text")

    def run(classes, digests, texts):
        pack = zstandard.ZstdCompressor(level=3).compress
        kept = [(c, pack(work.raw(t))) for c, d, t in zip(classes, digests, texts, strict=True) if xxhash.xxh3_128_digest(shingles(t, size).tobytes()) == d]
        return {"class": [c for c, _ in kept], "packed": [p for _, p in kept]}

    # Rows that repeat a doc_id may bear other texts: only those of the class count, and one of them.
    return work.map_batches(ids.join(keyed, "key"), run, "class bigint, packed binary", "class", "digest", "text").groupBy("class").agg(F.min("packed").alias("packed"))


def _may_link(n: Column, sketch: Column, other_n: Column, other_sketch: Column, percent: int) -> Column:
    """False only for pairs that cannot be links: by their sizes, or by more differing parities than alike sets can have."""
    differ = sum((F.bit_count(F.get(sketch, F.lit(i)).bitwiseXOR(F.get(other_sketch, F.lit(i)))) for i in range(SKETCH_BITS // 64)), F.lit(0))
    return (n * 100 >= other_n * percent) & (other_n * 100 >= n * percent) & (differ * (100 + percent) <= (n + other_n) * (100 - percent))


def _possible(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` that may be links, by ``sets(class, n, sketch)``."""
    left, right = (sets.select(F.col("class").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
    met = pairs.join(left, "a").join(right, "b")
    return met.where(_may_link(F.col("n_a"), F.col("sketch_a"), F.col("n_b"), F.col("sketch_b"), percent)).select("a", "b")


def _star(state: DataFrame, hubs: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Pairs of the next hubs of each bucket, ``hubs`` at most, with members of other components; the state after it.

    A bucket's hubs are the smallest member by number of each of ``hubs`` hash classes that was no hub yet: a minimum, so
    no bucket is ever gathered in one place.
    """
    slot = F.pmod(F.xxhash64("class"), F.lit(hubs)).alias("slot")
    hub = state.where("not hub").groupBy("bucket", slot).agg(F.min(F.struct("class", "n", "root", "sketch")).alias("h")).select("bucket", "h")
    a, b = F.col("h.class"), F.col("class")
    pairs = (
        state.join(hub, "bucket")
        .where((F.col("root") != F.col("h.root")) & _may_link(F.col("n"), F.col("sketch"), F.col("h.n"), F.col("h.sketch"), percent))
        .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .distinct()
    )
    was = hub.select("bucket", F.col("h.class").alias("class"), F.lit(True).alias("now"))
    return pairs, state.join(was, ["bucket", "class"], "left").withColumn("hub", F.coalesce("now", "hub")).drop("now")


def _undecided(state: DataFrame) -> DataFrame:
    """Members of buckets that hold several components and two members or more that were not hubs yet."""
    open_ = state.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.sum((~F.col("hub")).cast("int")).alias("waiting"))
    return state.join(open_.where("low <> high and waiting > 1").select("bucket"), "bucket")
