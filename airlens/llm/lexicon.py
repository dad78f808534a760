"""A minimal acyclic transducer from words to their token ids, kept in one file that workers map into memory.

States share their prefixes and, since equal states are one, their suffixes. Every arc carries a number; the numbers on a
word's arcs add up to its rank, and the rank points to the word's ids. Words are looked up many at a time: each step
follows one arc of all of them by a binary search in the sorted arcs.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from airlens.session import checkpoint_root

_ARRAYS = (("keys", np.int64), ("targets", np.uint32), ("numbers", np.uint32), ("final", np.uint8), ("offsets", np.uint32), ("ids", np.dtype("<u4")))


def compiled(entries: dict[bytes, list[int]]) -> bytes:
    """The file of ``entries``: word -> ids. Built word by word in byte order; a state that no later word can change is
    replaced by an equal one that is there already."""
    states: list[list] = [[False, {}]]  # of each state on the path of the last word: is final, arcs
    labels: list[int] = []
    done: list[tuple] = []
    known: dict[tuple, int] = {}

    def settle(depth: int) -> None:
        while len(labels) > depth:
            final, arcs = states.pop()
            key = (final, tuple(arcs.items()))
            if key not in known:
                known[key] = len(done)
                done.append(key)
            states[-1][1][labels.pop()] = known[key]

    words = sorted(entries)
    for word in words:
        shared = 0
        while shared < min(len(labels), len(word)) and labels[shared] == word[shared]:
            shared += 1
        settle(shared)
        for label in word[shared:]:
            labels.append(label)
            states.append([False, {}])
        states[-1][0] = True
    settle(0)
    root = (states[0][0], tuple(states[0][1].items()))
    order = [root, *reversed(done)]  # targets come after their sources; the root is state 0
    place = {s: len(done) - s for s in range(len(done))}
    below = np.zeros(len(order), np.int64)
    keys, targets, numbers, final = [], [], [], []
    for at in range(len(order) - 1, -1, -1):
        ends, arcs = order[at]
        below[at] = int(ends) + sum(int(below[place[t]]) for _, t in arcs)
    for at, (ends, arcs) in enumerate(order):
        final.append(ends)
        number = int(ends)
        for label, target in arcs:
            keys.append(at << 8 | label)
            targets.append(place[target])
            numbers.append(number)
            number += int(below[place[target]])
    lists = [entries[w] for w in words]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]) if lists else [0]
    ids = [i for x in lists for i in x]
    arrays = [np.asarray(x, kind) for x, (_, kind) in zip((keys, targets, numbers, final, offsets, ids), _ARRAYS, strict=True)]
    head = np.array([len(x) for x in arrays], np.int64).tobytes()
    return head + b"".join(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays)


class Lexicon:
    """A file of ``compiled``, mapped into memory: workers of a machine share its pages."""

    def __init__(self, path: str):
        held = np.asarray(np.memmap(path, np.uint8, "r"))  # a plain array over the mapped pages
        sizes, at = held[: 8 * len(_ARRAYS)].view(np.int64), 8 * len(_ARRAYS)
        for (name, kind), size in zip(_ARRAYS, sizes.tolist(), strict=True):
            n = size * np.dtype(kind).itemsize
            setattr(self, name, held[at : at + n].view(kind))
            at += n + -n % 8

    def find(self, words: list[bytes]) -> np.ndarray:
        """Rank of every word, -1 for those that are not in the lexicon."""
        rank = np.zeros(len(words), np.int64)
        if not words or not len(self.keys):
            return rank - 1
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(lengths) - lengths
        state = np.zeros(len(words), np.int64)
        alive, step = np.flatnonzero(lengths), 0
        while len(alive):
            wanted = state[alive] << 8 | flat[starts[alive] + step]
            arc = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            there = self.keys[arc] == wanted
            state[alive[~there]] = -1
            alive, arc = alive[there], arc[there]
            state[alive] = self.targets[arc]
            rank[alive] += self.numbers[arc]
            step += 1
            alive = alive[lengths[alive] > step]
        rank[(state < 0) | (self.final[state] == 0)] = -1
        return rank

    def outputs(self, ranks: np.ndarray) -> list[bytes]:
        """The ids of words by rank, as little-endian 32-bit numbers."""
        held = self.ids.data.cast("B")
        low, high = (self.offsets[ranks].astype(np.int64) * 4).tolist(), (self.offsets[ranks + 1].astype(np.int64) * 4).tolist()
        return [bytes(held[a:b]) for a, b in zip(low, high, strict=True)]


def published(spark: SparkSession, data: bytes) -> str:
    """Name under which every executor finds a file of ``data`` (``mapped``).

    It is written to the folder all machines share; Spark copies it once to each executor, also to later ones.
    """
    context = spark.sparkContext
    name = f"llm-{uuid.uuid4().hex}.lexicon"
    path = context._jvm.org.apache.hadoop.fs.Path(checkpoint_root(spark), name)
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(bytearray(data))
    out.close()
    context.addFile(files.makeQualified(path).toString())
    return name


def mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))
