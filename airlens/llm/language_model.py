"""Scores of documents by a masked language model: a small window network predicts every token from both sides."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airlens.llm import work

#: Token numbers: the most frequent words, then classes of the other words by their first letters. 32 * 32 in all. The
#: network predicts these; a word of a class has its share of the class besides.
SIDE = 32
FREQUENT = 640
CLASSES = SIDE * SIDE - FREQUENT
REACH = 2
WIDTH, HIDDEN = 16, 24
STEP, BATCH = 0.6, 512
MERGE = 32
#: Words whose counts travel to every task; the others are looked up by a join. How many do changes no result.
NEAR = 1 << 17
#: Words whose counts a task holds before it sends them on.
HELD = 300_000
#: Places scored at once.
SLICE = 1 << 12
#: Tokens of whole texts that are put in one row.
SPAN = 1 << 16


@dataclass
class Net:
    """Token vectors; one hidden layer over the neighbours; a token's number is predicted in two digits of base 32."""

    vectors: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    high: np.ndarray
    high_bias: np.ndarray
    given: np.ndarray
    low: np.ndarray
    low_bias: np.ndarray

    @classmethod
    def start(cls) -> Net:
        rng = np.random.default_rng(17)

        def normal(*shape: int) -> np.ndarray:
            return (rng.normal(size=shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)

        n = SIDE * SIDE + 1  # the last one stands beyond both ends
        return cls(
            normal(n, WIDTH) * np.float32(np.sqrt(n) * 0.3), normal(2 * REACH * WIDTH, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, SIDE), np.zeros(SIDE, np.float32),
            normal(SIDE, HIDDEN), normal(HIDDEN, SIDE), np.zeros(SIDE, np.float32),
        )

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, f.name).ravel() for f in fields(self)])

    @classmethod
    def of(cls, flat: np.ndarray) -> Net:
        model, at, parts = cls.start(), 0, []
        for f in fields(cls):
            shape = getattr(model, f.name).shape
            size = int(np.prod(shape))
            parts.append(flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return cls(*parts)

    def tables(self) -> list[np.ndarray]:
        """What a token at each place around adds to the hidden layer."""
        return [self.vectors @ self.inner[i * WIDTH : (i + 1) * WIDTH] for i in range(2 * REACH)]

    def log_probability(self, around: np.ndarray, token: np.ndarray, tables: list[np.ndarray] | None = None) -> np.ndarray:
        """Natural logarithm of each token's probability given its neighbours. ``tables``: this network's, if at hand."""
        high, low = token // SIDE, token % SIDE
        h = np.broadcast_to(self.inner_bias, (len(token), HIDDEN)).copy()
        taken = np.empty_like(h)
        for i, table in enumerate(self.tables() if tables is None else tables):
            h += _rows(table, around[:, i], taken)
        np.tanh(h, out=h)
        logs = _chosen(h @ self.high + self.high_bias, high)
        h += _rows(self.given, high, taken)
        np.tanh(h, out=h)
        return logs + _chosen(h @ self.low + self.low_bias, low)

    def train(self, around: np.ndarray, token: np.ndarray) -> None:
        """One pass of gradient steps over masked places, ``BATCH`` at a time, in arrays that all steps share."""
        f4 = np.float32
        most = min(BATCH, len(token))
        x_, dx_ = np.empty((most * 2 * REACH, WIDTH), f4), np.empty((most, 2 * REACH * WIDTH), f4)
        h_, g_, dh_, dg_, slope_ = (np.empty((most, HIDDEN), f4) for _ in range(5))
        da_, db_, digit_ = np.empty((most, SIDE), f4), np.empty((most, SIDE), f4), np.zeros((most, SIDE), f4)
        each_, row_ = np.ones(most, f4), np.arange(most) * SIDE
        cells = np.arange(self.vectors.size).reshape(self.vectors.shape)
        cell_ = np.empty((most * 2 * REACH, WIDTH), cells.dtype)
        for at in range(0, len(token), BATCH):
            ctx, tok = around[at : at + BATCH].ravel().astype(np.intp), token[at : at + BATCH].astype(np.intp)
            n = len(tok)
            h, g, dh, dg, slope, da, db, digit, each = (a[:n] for a in (h_, g_, dh_, dg_, slope_, da_, db_, digit_, each_))
            hi = tok // SIDE
            hi_cell, lo_cell = row_[:n] + hi, row_[:n] + tok % SIDE
            x = _rows(self.vectors, ctx, x_[: len(ctx)]).reshape(n, -1)
            np.matmul(x, self.inner, out=h)
            h += self.inner_bias
            np.tanh(h, out=h)
            _rows(self.given, hi, g)
            g += h
            np.tanh(g, out=g)
            _softmax(h, self.high, self.high_bias, da)
            _softmax(g, self.low, self.low_bias, db)
            da.ravel()[hi_cell] -= 1
            db.ravel()[lo_cell] -= 1
            np.matmul(db, self.low.T, out=dg)
            dg *= _slope(g, slope)
            np.matmul(da, self.high.T, out=dh)
            dh += dg
            dh *= _slope(h, slope)
            dx = np.matmul(dh, self.inner.T, out=dx_[:n])
            rate = f4(STEP / n)
            self.low -= rate * (g.T @ db)
            self.low_bias -= rate * (each @ db)
            self.high -= rate * (h.T @ da)
            self.high_bias -= rate * (each @ da)
            digit.ravel()[hi_cell] = 1
            self.given -= rate * (digit.T @ dg)
            digit.ravel()[hi_cell] = 0
            self.inner -= rate * (x.T @ dh)
            self.inner_bias -= rate * (each @ dh)
            # what a token's places add, summed up entry by entry
            sums = np.bincount(_rows(cells, ctx, cell_[: len(ctx)]).ravel(), dx.ravel(), cells.size)
            sums *= STEP / np.sqrt(n)
            self.vectors -= sums.reshape(cells.shape).astype(f4)


def _rows(table: np.ndarray, index: np.ndarray, out: np.ndarray) -> np.ndarray:
    """``table[index]`` in ``out``; several times as fast as by brackets. "clip" lets it write there without a copy between."""
    return table.take(index, 0, out=out, mode="clip")


def _slope(y: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Slope of tanh where it is ``y``."""
    np.multiply(y, y, out=out)
    return np.subtract(1, out, out=out)


_ONES = np.ones(SIDE, np.float32)


#: Beyond this, exponentials are taken of differences to a row's largest entry: a float of 32 bits holds e^88.
WIDE = 60


def _softmax(x: np.ndarray, weights: np.ndarray, bias: np.ndarray, out: np.ndarray) -> np.ndarray:
    np.matmul(x, weights, out=out)
    out += bias
    if out.max() > WIDE or out.min() < -WIDE:
        out -= out.max(1, keepdims=True)
    np.exp(out, out=out)
    out *= (1 / (out @ _ONES))[:, None]
    return out


def _chosen(x: np.ndarray, index: np.ndarray) -> np.ndarray:
    """The chosen entry of each row of the logarithm of the softmax of ``x``, without the others; ``x`` is used up."""
    if x.max() > WIDE or x.min() < -WIDE:
        x -= x.max(1, keepdims=True)
    chosen = x.ravel().take(np.arange(0, x.size, SIDE) + index)
    return chosen - np.log(np.exp(x, out=x) @ _ONES)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, n`` of every lower-cased word of every text, as a written table. A task sums up before it sends: it lets its
    counts go whenever they hold ``HELD`` words."""

    def run(batches):
        import pyarrow as pa

        def sent(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        counts: Counter = Counter()
        for batch in work.slices(batches):
            for text in batch.column("text").to_pylist():
                counts.update(work.words_of(work.raw(text).lower()))
            if len(counts) > HELD:
                yield sent(counts)
                counts.clear()
        yield sent(counts)
        work.give_back()

    return work.written(docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))


def most_frequent(counts: DataFrame, most: int = FREQUENT) -> list[bytes]:
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(most).collect()]


def frequent_words(docs: DataFrame, most: int = FREQUENT) -> list[bytes]:
    """The most frequent lower-cased words of all documents, ties in byte order; counted over every word of every text."""
    return most_frequent(word_counts(docs), most)


class Tokens:
    """Word to token number: its rank if it is frequent, else a class by its first three bytes."""

    def __init__(self, words: list[bytes]):
        self.known = {w: i for i, w in enumerate(words)}
        self.classes: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        start = word[:3]
        found = self.classes.get(start)
        if found is None:
            found = self.classes[start] = FREQUENT + int(work.hashes_of([start])[0] % np.uint64(CLASSES))
        return found

    def of_words(self, words: list[bytes]) -> np.ndarray:
        get, other = self.known.get, self.__missing__
        return np.fromiter((other(w) if (i := get(w)) is None else i for w in words), np.int64, len(words))

    def of(self, text: str | None) -> np.ndarray:
        return self.of_words(work.words_of(work.raw(text).lower()))


class Shares:
    """Logarithms of the words' shares of their classes: ``n / (N + 1)`` for a word that stands ``n`` times in the corpus.

    ``N`` is the class's words in the corpus, the one more is for words that are not there (``n = 1`` for each of them).
    Frequent words are no class: their share is 1. ``near`` holds ``ln n`` of the words that stand ``least`` times or more.
    """

    def __init__(self, totals: dict[int, int], near: dict[bytes, float]):
        self.class_log = np.zeros(SIDE * SIDE)
        for token, n in totals.items():
            if token >= FREQUENT:
                self.class_log[token] = -np.log(n + 1.0)
        self.near = near

    def of(self, words: list[bytes], tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word the logarithm of its share, but for ``ln n`` where it is not near, and whether that is so."""
        logs = self.class_log[tokens]
        far = np.zeros(len(words), bool)
        for i in np.flatnonzero(tokens >= FREQUENT).tolist():
            log = self.near.get(words[i])
            if log is None:
                far[i] = True
            else:
                logs[i] += log
        return logs, far


class _Numbers(dict):
    """Place of each word in two arrays, of token numbers and of logarithms: first the words with counts at hand, kept, then
    others as they come, which ``forget`` drops."""

    def __init__(self, tokens: Tokens, shares: Shares):
        kept = list(dict.fromkeys([*tokens.known, *shares.near]))
        super().__init__(zip(kept, range(len(kept)), strict=True))
        self.tokens, self.near = tokens, len(kept)
        number = tokens.of_words(kept)
        self.fixed = number.astype("<u2"), shares.of(kept, number)[0]
        self.class_log = shares.class_log
        self.far: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        found = self[word] = self.near + len(self.far)
        self.far.append(word)
        return found

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        number = self.tokens.of_words(self.far)
        return np.append(self.fixed[0], number.astype("<u2")), np.append(self.fixed[1], self.class_log[number])

    def forget(self) -> None:
        for word in self.far:
            del self[word]
        self.far = []


def least_near(counts: DataFrame, most: int) -> int:
    """The smallest count that ``most`` words at most reach."""
    reach, least = 0, 1 << 62
    # every count is that of a word at least, so no more of them can be needed
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most + 1).collect():
        reach += r.words
        if reach > most:
            break
        least = r.n
    return max(least, 2)


def shares_of(counts: DataFrame, tokens, least: int) -> Shares:
    def run(words, ns):
        numbers = tokens.value.of_words(words)
        sums = np.bincount(numbers, weights=np.array(ns, np.float64), minlength=SIDE * SIDE)
        at = np.flatnonzero(sums)
        return {"token": at, "n": sums[at].astype(np.int64)}

    totals = work.map_batches(counts, run, "token bigint, n bigint", "word", "n").groupBy("token").agg(F.sum("n").alias("n")).collect()
    near = counts.where(F.col("n") >= least).collect()
    return Shares({r.token: r.n for r in totals}, {bytes(r.word): float(np.log(r.n)) for r in near if bytes(r.word) not in tokens.value.known})


def windows(tokens: np.ndarray) -> np.ndarray:
    """Neighbours of every token, ``REACH`` on each side; beyond the ends stands a token of its own."""
    edge = np.full(REACH, SIDE * SIDE)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([edge, tokens, edge]), 2 * REACH + 1)
    return np.delete(view, REACH, axis=1)


def masked(around: np.ndarray, tokens: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which places of a text round ``part`` of ``parts`` masks: by a hash of token, neighbour and number, each in one round."""
    return _masked(around[:, REACH - 1], np.arange(len(tokens)), tokens, part, parts)


def _masked(left: np.ndarray, number: np.ndarray, tokens: np.ndarray, part: int, parts: int) -> np.ndarray:
    spot = work.mixed(left.astype(np.uint64) * work.GOLDEN + number.astype(np.uint64) + tokens.astype(np.uint64) * work.STEP)
    return spot % np.uint64(parts) == part


_EDGE = np.full(REACH, SIDE * SIDE, "<u2").tobytes()


class Row:
    """Several texts in token numbers, one after the other: one array call serves them all, however short they are.

    ``values`` has ``REACH`` edges before, between and behind them, ``sizes`` their lengths, ``text`` the text of each token,
    ``place`` its place in ``values``.
    """

    def __init__(self, packed: list[bytes]):
        self.values = np.frombuffer(_EDGE.join([b"", *packed, b""]), "<u2")
        self.sizes = np.fromiter(map(len, packed), np.int64, len(packed)) // 2
        self.text = np.repeat(np.arange(len(packed), dtype=np.int32), self.sizes)
        self.place = np.arange(len(self.text))
        self.place += REACH
        self.place += REACH * self.text

    def around(self, place: np.ndarray) -> np.ndarray:
        """Neighbours of the tokens at these places, as ``windows`` has them."""
        return np.stack([self.values.take(place + step) for step in range(-REACH, REACH + 1) if step]).T

    def masked(self, part: int, parts: int) -> np.ndarray:
        """Places that ``masked`` chooses in each text."""
        first = np.cumsum(self.sizes) - self.sizes
        number = np.arange(len(self.text)) - first.take(self.text)
        return self.place[_masked(self.values.take(self.place - 1), number, self.values.take(self.place), part, parts)]


def rows_of(packed: list[bytes]) -> Iterator[Row]:
    """The texts in order, a row each time they come to ``SPAN`` tokens."""
    held, size = [], 0
    for data in packed:
        held.append(data)
        size += len(data) // 2
        if size >= SPAN:
            yield Row(held)
            held, size = [], 0
    if held:
        yield Row(held)


@dataclass
class Corpus:
    """Texts as token numbers: ``table(row, doc_id, tokens, part, far)``, written once and read by every round.

    ``tokens``: two bytes a word. ``part``: the sum of the words' shares of their classes, but for the words in ``far`` (with
    their counts in the text), whose corpus counts, all under ``least``, are looked up by a join.
    """

    words: list[bytes]
    counts: DataFrame
    table: DataFrame
    least: int


def corpus(docs: DataFrame, near: int = NEAR, words: list[bytes] | None = None, counts: DataFrame | None = None) -> Corpus:
    """The texts of ``docs(doc_id, text)`` in numbers of ``words`` (by default their own most frequent ones), with shares by
    ``counts`` (by default their own). ``near`` words at most are sent to all tasks with their counts."""
    context = docs.sparkSession.sparkContext
    counts = word_counts(docs) if counts is None else counts
    words = most_frequent(counts) if words is None else words
    tokens = context.broadcast(Tokens(words))
    least = least_near(counts, near)
    shares = context.broadcast(shares_of(counts, tokens, least))

    name = uuid.uuid4().hex

    def run(ids, texts):
        index = work.per_process(("numbers", name), lambda: _Numbers(tokens.value, shares.value))
        places = [np.fromiter(map(index.__getitem__, w), np.int64, len(w)) for w in (work.words_of(work.raw(t).lower()) for t in texts)]
        number, logs = index.arrays()
        packed, parts, far = [], [], []
        for at in places:
            packed.append(number[at].tobytes())
            parts.append(float(logs[at].sum()))
            far.append([{"word": index.far[i - index.near], "k": k} for i, k in Counter(at[at >= index.near].tolist()).items()])
        index.forget()
        return {"doc_id": ids, "tokens": packed, "part": parts, "far": far}

    schema = "doc_id bigint, tokens binary, part double, far array<struct<word:binary, k:bigint>>"
    table = work.written(work.map_batches(docs, run, schema, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()))
    return Corpus(words, counts, table, least)


def _train_round(table: DataFrame, net, part: int, parts: int) -> np.ndarray:
    """Mean of the networks that tasks train on their documents, weighed by masked places.

    Every document takes part, and every place of it is masked in one of the ``parts`` rounds. The networks of tasks are
    added up on executors, ``MERGE`` at a time, until few are left.
    """

    def learn(batches):
        import pyarrow as pa

        own, seen = Net.of(net.value), 0
        for batch in work.slices(batches):
            contexts, targets = [], []
            for texts in rows_of(batch.column("tokens").to_pylist()):
                chosen = texts.masked(part, parts)
                contexts.append(texts.around(chosen))
                targets.append(texts.values.take(chosen))
            if sum(map(len, targets)):
                context, target = np.concatenate(contexts), np.concatenate(targets)
                order = np.random.default_rng(len(target)).permutation(len(target))
                own.train(context.take(order, 0), target.take(order))
                seen += len(target)
        if seen:
            flat = (own.flat().astype(np.float64) * seen).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([flat], pa.binary()), pa.array([seen], pa.int64())], names=["total", "n"])

    def add(batches):
        import pyarrow as pa

        total, n = 0.0, 0
        for batch in batches:
            for flat, k in zip(batch.column("total").to_pylist(), batch.column("n").to_pylist(), strict=True):
                total, n = total + np.frombuffer(flat), n + k
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["total", "n"])

    sums = work.written(table.select("tokens").mapInArrow(learn, "total binary, n bigint"))
    while (left := sums.count()) > MERGE:
        sums = work.written(sums.repartition(-(-left // MERGE)).mapInArrow(add, "total binary, n bigint"))
    rows = sums.collect()
    if not rows:
        return net.value
    return (sum(np.frombuffer(r.total) for r in rows) / sum(r.n for r in rows)).astype(np.float32)


def fit(texts: Corpus, rounds: int = 2) -> np.ndarray:
    """Weights of a network trained on every place of all texts, in rounds with a common mean after each.

    A task trains its own network on the rows it holds, from the mean of the round before: so another dealing of rows to
    tasks gives another network, as another order of its samples gives any network that steps train. The dealing is that
    of the written table's files, alike when the same files are read again.
    """
    context = texts.table.sparkSession.sparkContext
    weights = Net.start().flat()
    for part in range(rounds):
        weights = _train_round(texts.table, context.broadcast(weights), part, rounds)
    return weights


def train(docs: DataFrame, rounds: int = 2) -> tuple[list[bytes], np.ndarray, DataFrame]:
    """Frequent words, ``fit`` weights and word counts of ``docs``."""
    texts = corpus(docs)
    return texts.words, fit(texts, rounds), texts.counts


def pseudo_likelihood(docs: DataFrame, words: list[bytes], weights: np.ndarray, counts: DataFrame | None = None, near: int = NEAR) -> DataFrame:
    """``scores`` of ``docs`` under words, weights and counts of a corpus, its own or another (``train``)."""
    return scores(corpus(docs, near, words, counts), weights)


def log_likelihoods(model: Net, packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text in token numbers the sum of its places' logarithms of probabilities, and its length."""
    tables = model.tables()
    sums, sizes = [np.empty(0)], [np.empty(0, np.int64)]
    for texts in rows_of(packed):
        total = np.zeros(len(texts.sizes))
        for at in range(0, len(texts.place), SLICE):
            place, text = texts.place[at : at + SLICE], texts.text[at : at + SLICE]
            logs = model.log_probability(texts.around(place), texts.values.take(place).astype(np.intp), tables)
            total[text[0] : text[-1] + 1] += np.bincount(text - text[0], logs)
        sums.append(total)
        sizes.append(texts.sizes)
    return np.concatenate(sums), np.concatenate(sizes)


def scores(texts: Corpus, weights: np.ndarray) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean_log_likelihood, pseudo_perplexity`` of every row.

    Each token of the whole text is masked in turn and predicted from both sides; the document's score is the sum of the
    natural logarithms of these probabilities. A word that is not among the frequent ones has the probability of its class
    times its share of the class by the counts; a word the counts lack counts as one that stands there once. Null texts and
    texts without words: 0 tokens, sum 0, the others null. Rows are scored one by one, so repeated rows and null ids come
    out as they are; other columns are ignored.
    """
    net = texts.table.sparkSession.sparkContext.broadcast(weights)

    def run(rows, ids, packed, parts):
        sums, sizes = log_likelihoods(Net.of(net.value), packed)
        sums += np.array(parts, np.float64)
        return {"row": rows, "doc_id": ids, "n_tokens": sizes, "part": sums}

    scored = work.map_batches(texts.table, run, "row bigint, doc_id bigint, n_tokens bigint, part double", "row", "doc_id", "tokens", "part")
    # Words that stand once, or not at all, add ln 1.
    logs = texts.counts.where((F.col("n") > 1) & (F.col("n") < texts.least)).select("word", F.log("n").alias("log"))
    found = texts.table.select("row", F.explode("far").alias("f")).select("row", "f.word", "f.k").join(logs, "word").groupBy("row").agg(F.sum(F.col("k") * F.col("log")).alias("rest"))
    whole = F.col("part") + F.coalesce("rest", F.lit(0.0))
    mean = F.when(F.col("n_tokens") > 0, whole / F.col("n_tokens"))
    return scored.join(found, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"), mean.alias("mean_log_likelihood"), F.exp(-mean).alias("pseudo_perplexity"))
