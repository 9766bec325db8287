"""Spelling variants by a frequency-vector trie.

Words are counted by Spark from blocks that tasks count in memory. A word's frequency vector has the number of its code points in
each of ``GROUPS`` letter groups (code point modulo ``GROUPS``; the groups of the largest variance first). The words make a trie: one
level per group, children by count. Words one code point apart have vectors that differ by a surplus of at most one and
a deficit of at most one, so a search goes down to the child of the same count, or to that of one more or one less
while it has not spent its surplus or its deficit. What is left of a subtree of at most ``LEAF`` words is verified.

The first ``TOP`` levels deal the trie to tasks: each combination of their counts is one subtree. A word enters its own subtree, and
is sent as a search to its own and to those that can be reached by spending in the top levels, in one direction only, so that each
pair is found once. Subtrees of more than ``SUBTREE`` words are cut in parts by hash, and searches go to every part; a task
holds one part's words, and searches stream past them. Near words are combined per task before they are shuffled.

Edge cases: null and empty texts have no words; a null doc_id counts as an empty one in the hash; rows that share an id are each
counted; ties of n go to the smallest word; a word without near words has no form, is its own root and has n_near 0; an empty table gives
no rows. Very long texts are read in pieces, very long words are compared like others, by classes of length.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import partitions, spaced, stored

#: One occurrence of a text's word in so many loses a code point; least length and occurrences of words.
DROPPED, LENGTH, OFTEN, RATIO = 199, 6, 5, 5
GROUPS, TOP, LEAF = 24, 6, 24
#: Words of a task's block, bytes of text split at a time, words of a part of a subtree, rows searched at a time, code points compared at a time.
BLOCK, TEXT, SUBTREE, ROWS, CELLS = 400_000, 1 << 22, 1 << 16, 1 << 18, 1 << 22
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def count_words(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """word, n: runs of letters, lower-cased, one in ``DROPPED`` without a code point; those of ``often`` or more."""
    import pyarrow as pa

    def count(batches: Iterator) -> Iterator:
        block: Counter = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in block], pa.string()), pa.array(list(block.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                # Every letter asked for is one byte here; all else becomes a space.
                seed, plain = crc32(f"{'' if doc_id is None else doc_id}:".encode()), (text.as_py() or "").encode("latin-1", "replace")
                own: Counter = Counter()
                for words in spaced(plain, _TABLE, TEXT):
                    own.update(words)
                for word, n in own.items():
                    size = len(word)
                    if size < LENGTH:
                        continue
                    h = crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
                    if h % DROPPED == 0:
                        if size == LENGTH:
                            continue
                        word = word[:h % size] + word[h % size + 1:]
                    block[word] += n
                if len(block) >= BLOCK:
                    yield send()
                    block.clear()
        yield send()

    counted = docs.select("doc_id", "text").mapInArrow(count, "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


class Points:
    """Words as code points."""

    def __init__(self, words: list[str]):
        self.flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.size = np.fromiter(map(len, words), np.int64, len(words))
        self.start = np.cumsum(self.size) - self.size

    def vectors(self) -> np.ndarray:
        """Counts by group, modulo 256."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        flat = np.bincount(row * GROUPS + self.flat % GROUPS, minlength=len(self.size) * GROUPS)
        return flat.reshape(-1, GROUPS).astype(np.uint8)

    def _cut(self, i: np.ndarray, width: int) -> np.ndarray:
        col = np.arange(width)
        inside = col < self.size[i][:, None]
        return np.where(inside, self.flat[np.where(inside, self.start[i][:, None] + col, 0)], 0)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words a and b differ by exactly one inserted, deleted or replaced code point."""
        out = np.zeros(len(a), bool)
        swap = self.size[a] < self.size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)  # the first is the longer one
        by = np.flatnonzero(self.size[a] - self.size[b] <= 1)
        kind = np.ceil(np.log2(self.size[a[by]] + 1)).astype(np.int64)
        for k in np.unique(kind):
            own, width = by[kind == k], 1 << int(k)
            step = max(1, CELLS // width)
            for s in range(0, len(own), step):
                i = own[s:s + step]
                x, y = self._cut(a[i], width), self._cut(b[i], width)
                differ = x != y
                same_size = self.size[a[i]] == self.size[b[i]]
                # One more code point: what follows the first difference is the same, one place further.
                first = differ.argmax(1)
                shifted = np.concatenate([x[:, 1:], np.zeros((len(i), 1), x.dtype)], 1) != y
                after = (shifted & (np.arange(width) >= first[:, None])).any(1)
                out[i] = np.where(same_size, differ.sum(1) == 1, ~after)
        return out


def search(bucket: np.ndarray, words: np.ndarray, asked: np.ndarray, asks: np.ndarray, role: np.ndarray, rest: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidates (word that asks, word found): depth first through the subtrees.

    ``bucket`` and ``words``: the subtree of each word in it; ``asked``, ``asks``, ``role``: the subtree each search goes to, its word, what it
    has spent before (1 nothing, 2 its deficit, 3 both); ``rest``: the levels of all words below the top.
    """
    order = np.lexsort((*rest[words].T[::-1], bucket))
    bucket, words = bucket[order], words[order]
    order = np.argsort(asked, kind="stable")
    asked, asks, role = asked[order], asks[order], role[order]
    vectors, levels = rest[words], rest.shape[1]
    stack = []
    for b in np.unique(asked):
        low, high = np.searchsorted(bucket, [b, b + 1])
        first, last = np.searchsorted(asked, [b, b + 1])
        if low < high:
            stack.append((int(low), int(high), 0, asks[first:last], role[first:last] < 3, role[first:last] < 2))
    while stack:
        low, high, level, own, surplus, deficit = stack.pop()
        if high - low <= LEAF or level == levels:
            step = max(1, CELLS // ((high - low) * max(1, levels - level)))
            for s in range(0, len(own), step):
                part = own[s:s + step]
                d = vectors[None, low:high, level:] - rest[part, level:][:, None]
                more, less = (d == 1).sum(2), (d == 255).sum(2)
                ok = (more + less == (d != 0).sum(2)) & (more <= surplus[s:s + step, None]) & (less <= deficit[s:s + step, None])
                i, j = np.nonzero(ok)
                yield part[i], words[low + j]
            continue
        column = vectors[low:high, level]
        edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), high - low]
        asked_for = rest[own, level]
        for a, b in zip(edges[:-1], edges[1:]):
            d = column[a] - asked_for
            go = np.flatnonzero((d == 0) | ((d == 1) & surplus) | ((d == 255) & deficit))
            if len(go):
                d = d[go]
                stack.append((low + a, low + b, level + 1, own[go], surplus[go] & (d != 1), deficit[go] & (d != 255)))


def level_order(words: DataFrame) -> list[int]:
    """The letter groups, those of the largest variance over all words first."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            v = Points(batch.column("word").to_pylist()).vectors().astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(range(GROUPS), pa.int32()), pa.array([len(v)] * GROUPS, pa.int64()), pa.array(v.sum(0)), pa.array((v * v).sum(0))],
                                             ["grp", "many", "one", "two"])

    sums = words.select("word").mapInArrow(run, "grp int, many bigint, one bigint, two bigint").groupBy("grp").agg(F.sum("many"), F.sum("one"), F.sum("two"))
    spread = {g: two * many - one * one for g, many, one, two in sums.collect()}  # GROUPS rows
    return sorted(range(GROUPS), key=lambda g: (-spread.get(g, 0), g))


def _packed(top: np.ndarray) -> np.ndarray:
    """Counts of the top levels in one number."""
    return (top.astype(np.int64) << (8 * np.arange(TOP))).sum(-1)


def _steps() -> list[tuple[int, np.ndarray]]:
    """Role and change of the top levels for each subtree that a search goes to."""
    one = np.eye(TOP, dtype=np.uint8)
    return [(1, np.zeros(TOP, np.uint8)), *((2, -one[i]) for i in range(TOP)), *((3, one[j] - one[i]) for i, j in itertools.combinations(range(TOP), 2))]


def dealt(words: DataFrame, order: list[int]) -> DataFrame:
    """key, part, role, word, n: the words in their subtrees (role 0), and the searches that subtrees get."""
    import pyarrow as pa

    steps = _steps()

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            top = Points(batch.column("word").to_pylist()).vectors()[:, order[:TOP]]
            keys = np.stack([_packed(top), *(_packed(top + step) for _, step in steps)], 1).ravel()
            roles = np.tile(np.array([0, *(r for r, _ in steps)], np.int8), len(top))
            again = pa.array(np.repeat(np.arange(len(top)), len(steps) + 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(roles), batch.column("word").take(again), batch.column("n").take(again)], ["key", "role", "word", "n"])

    rows = words.select("word", "n").mapInArrow(run, "key bigint, role tinyint, word string, n bigint")
    sizes = rows.filter("role = 0").groupBy("key").agg(F.ceil(F.count("*") / F.lit(SUBTREE)).cast("int").alias("parts"))
    part = F.when(F.col("role") == 0, F.array(F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.join(sizes, "key").select("key", F.explode(part).alias("part"), "role", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (a struct of -n and the word): the near words of each word that has any."""
    import pyarrow as pa
    import pyarrow.compute as pc

    order = level_order(words)
    names = ["key", "part", "role", "word", "n"]

    def found(table):
        """word, n_near, n, other over the searches of a table."""
        coded = table.column("word").combine_chunks().dictionary_encode()
        own, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        n = np.zeros(len(own), np.int64)
        n[ids] = table.column("n").to_numpy()
        points = Points(own.to_pylist())
        rest = points.vectors()[:, order[TOP:]]
        key, part, role = (table.column(c).to_numpy() for c in names[:3])
        bucket = np.cumsum(np.append(True, (key[1:] != key[:-1]) | (part[1:] != part[:-1])))
        inside = role == 0
        place = np.empty(len(own), np.int64)  # the same order of words in all tables
        place[pc.sort_indices(own).to_numpy()] = np.arange(len(own))
        pairs = [(np.zeros(0, np.int64),) * 2]
        waiting, size = [], 0
        role_of = role[~inside]

        def checked():
            a, b = (np.concatenate(x) for x in zip(*waiting))
            ok = points.near(a, b)
            pairs.append((a[ok], b[ok]))

        for same in (True, False):  # within one subtree each pair is met from both sides
            some = (role_of == 1) == same
            for a, b in search(bucket[inside], ids[inside], bucket[~inside][some], ids[~inside][some], role_of[some], rest):
                if same:
                    a, b = a[place[a] < place[b]], b[place[a] < place[b]]
                waiting.append((a, b))
                size += len(a)
                if size >= CELLS // 16:
                    checked()
                    waiting, size = [], 0
        if waiting:
            checked()
        a, b = (np.concatenate(x) for x in zip(*pairs))
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        if not len(a):
            return None
        by = np.lexsort((place[b], -n[b], a))
        a, b = a[by], b[by]
        head = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        many = np.diff(np.append(head, len(a)))
        return pa.RecordBatch.from_arrays([own.take(pa.array(a[head])), pa.array(many), pa.array(n[b[head]]), own.take(pa.array(b[head]))], ["word", "n_near", "n", "other"])

    def run(batches: Iterator) -> Iterator:
        waiting, rows = [], 0
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                rows += batch.num_rows
            if rows < ROWS and batch is not None or not waiting:
                continue
            table = pa.Table.from_batches(waiting)
            if (out := found(table)) is not None:
                yield out
            # The last subtree may get further searches: its words stay.
            last = pc.and_(pc.and_(pc.equal(table.column("key"), table.column("key")[-1]), pc.equal(table.column("part"), table.column("part")[-1])), pc.equal(table.column("role"), 0))
            waiting = table.filter(last).combine_chunks().to_batches()
            rows = 0

    rows = dealt(words, order).repartition(partitions(words.sparkSession), "key", "part").sortWithinPartitions("key", "part", "role")
    out = rows.mapInArrow(run, "word string, n_near bigint, n bigint, other string")
    return out.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("n")).alias("n"), "other")).alias("best"))


def spelling_variants(docs: DataFrame, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    spark = docs.sparkSession
    words = stored(spark, count_words(docs, often), "words")
    near = words.join(near_words(words), "word", "left")
    much = -F.col("best.n") >= ratio * F.col("n")
    out = near.select("word", F.when(much, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(much, -F.col("best.n")).alias("form_n"))
    out = stored(spark, out, "variants")
    # Each form occurs ``ratio`` times as often, so chains are short; each round doubles the steps taken.
    most = out.agg(F.max("form_n")).first()[0]
    steps = math.floor(math.log(max(1, most / often)) / math.log(ratio)) + 1 if most else 0
    to = out.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(1, steps))))):
        on = to.select(F.col("word").alias("root"), F.col("root").alias("next"))
        to = to.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"))
    return out.join(to, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
