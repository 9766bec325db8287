"""Exact dedup by a sharded cuckoo-filter index of live digests.

A text's digest is the SHA-256 of its lower-cased form (A-Z only). Each task combines the equal digests of a batch and
sends one row for each, so a text that a third of the rows share leaves a task once a batch. Digests are dealt by hash to
shards; a shard streams through a ``CuckooIndex``: a filter of 16-bit fingerprints in buckets of four slots, beside each slot
the number of the stored key it stands for. A fingerprint that is met is verified against the whole stored digest; digests that
are not in the index are inserted, and where a fingerprint finds no place after ``KICKS`` rounds of evictions the filter is built
again from the stored keys with twice the buckets. Digests can be deleted, which frees their slots and keys.

The index is a table, one row per live digest (digest, doc_id of the row that stays, its row number, copies), so it outlives
executors: ``build`` makes it, ``merged`` adds another index, ``withdrawn`` deletes the digests of given texts. An index by
itself holds some 70 bytes for each live digest of its shard; there are as many shards as shuffle partitions.

Edge cases: a null text is empty. Of equal texts the row with the largest doc_id stays; of rows that share it too, one.
A row without doc_id stays only where no copy has an id; its keep_id is null. Rows that share a doc_id are judged each by its
own text. An empty table gives no rows. Texts are hashed whole, in the JVM; no text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import lower_ascii, mix64, partitions, stored

#: Slots of a bucket; rounds of evictions, and part of the slots in use, beyond which the filter grows; the least number of buckets (a power of two).
SLOTS, KICKS, FULL, LEAST = 4, 64, 0.95, 64
SIZE = 32
ENTRY = "digest binary, doc_id bigint, row bigint, copies bigint"
_FREE = np.uint16(0)


class CuckooIndex:
    """Live digests (rows of 32 bytes): a cuckoo filter whose slots lead to the stored digests.

    All calls take arrays of distinct digests, shape (n, 32).
    """

    def __init__(self, buckets: int = LEAST):
        self.keys = np.zeros((LEAST, SIZE), np.uint8)
        self.live = np.zeros(LEAST, bool)
        self.used, self.free = 0, np.zeros(0, np.int64)
        self.resized = 0
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = np.int64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.entry = np.zeros((buckets, SLOTS), np.int64)

    def __len__(self) -> int:
        return int(self.live[:self.used].sum())

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (never zero) and first buckets; digests are random bits already."""
        words = np.ascontiguousarray(keys).view("<u8")
        return np.maximum((words[:, 0] >> np.uint64(48)).astype(np.uint16), 1), (words[:, 1] >> np.uint64(8)).astype(np.int64) & self.mask

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint; the second of the second is the first."""
        return bucket ^ (mix64(prints.astype(np.uint64)) >> np.uint64(8)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of digests, -1 where a digest is not live. Equal fingerprints are verified against the stored digest."""
        out = np.full(len(keys), -1, np.int64)
        prints, bucket = self._places(keys)
        for b in (bucket, self._other(bucket, prints)):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[b, slot] == prints) & (out < 0))
                at = self.entry[b[hit], slot]
                same = (self.keys[at] == keys[hit]).all(1)
                out[hit[same]] = at[same]
        return out

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Entries of digests that are not live yet."""
        at = self._store(keys)
        self._fill(at)
        return at

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Take digests out; their entries, -1 where a digest was not live."""
        at = self.find(keys)
        prints, bucket = self._places(keys)
        for b in (bucket, self._other(bucket, prints)):
            for slot in range(SLOTS):
                own = np.flatnonzero((at >= 0) & (self.prints[b, slot] == prints) & (self.entry[b, slot] == at))
                self.prints[b[own], slot] = _FREE
        gone = at[at >= 0]
        self.live[gone] = False
        self.free = np.concatenate([self.free, gone])
        return at

    def _store(self, keys: np.ndarray) -> np.ndarray:
        again, self.free = self.free[:len(keys)], self.free[len(keys):]
        more = len(keys) - len(again)
        if self.used + more > len(self.keys):
            room = max(2 * len(self.keys), self.used + more)
            self.keys = np.concatenate([self.keys, np.zeros((room - len(self.keys), SIZE), np.uint8)])
            self.live = np.concatenate([self.live, np.zeros(room - len(self.live), bool)])
        at = np.concatenate([again, np.arange(self.used, self.used + more)])
        self.used += more
        self.keys[at], self.live[at] = keys, True
        return at

    def _fill(self, at: np.ndarray) -> None:
        """Give entries slots; where evictions do not end the filter grows and all live keys are placed anew."""
        if self._place(at):
            return
        while True:
            self.resized += 1
            self._clear(2 * (int(self.mask) + 1))
            if self._place(np.flatnonzero(self.live[:self.used])):
                return

    def _place(self, at: np.ndarray) -> bool:
        prints, bucket = self._places(self.keys[at])
        if len(self) > FULL * SLOTS * len(self.prints):
            return False
        for turn in range(KICKS):
            for _ in range(2):  # a free slot in either bucket
                left = self._into_free(at, prints, bucket)
                at, prints, bucket = at[left], prints[left], bucket[left]
                if not len(at):
                    return True
                bucket = self._other(bucket, prints)
            # One newcomer of each bucket takes the slot of an older entry, which goes on to its other bucket.
            first = np.unique(bucket, return_index=True)[1]
            slot = (at[first] + turn) % SLOTS
            b = bucket[first]
            old_print, old = self.prints[b, slot].copy(), self.entry[b, slot].copy()
            self.prints[b, slot], self.entry[b, slot] = prints[first], at[first]
            prints[first], at[first] = old_print, old
            bucket[first] = self._other(b, old_print)
        return False

    def _into_free(self, at: np.ndarray, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Places what finds a free slot in its bucket; indices of the rest."""
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        begin = np.flatnonzero(np.append(True, b[1:] != b[:-1])) if len(b) else np.zeros(0, np.int64)
        rank = np.arange(len(b)) - np.repeat(begin, np.diff(np.append(begin, len(b))))
        empty = self.prints[b] == _FREE
        fits = rank < empty.sum(1)
        # The rank-th free slot of the bucket.
        slot = ((np.cumsum(empty, 1) == rank[:, None] + 1) & empty).argmax(1)
        i = order[fits]
        self.prints[b[fits], slot[fits]], self.entry[b[fits], slot[fits]] = prints[i], at[i]
        return order[~fits]


class _Rows:
    """What the index keeps beside each digest: the best (has an id, id, row number) and the number of copies."""

    def __init__(self):
        self.index = CuckooIndex()
        self.doc, self.has, self.row, self.copies = (np.zeros(LEAST, k) for k in (np.int64, bool, np.int64, np.int64))

    def add(self, keys: np.ndarray, doc: np.ndarray, has: np.ndarray, row: np.ndarray, copies: np.ndarray) -> None:
        keys, doc, has, row, copies = combined(keys, doc, has, row, copies)
        at = self.index.find(keys)
        known = at >= 0
        if not known.all():
            at[~known] = self.index.insert(keys[~known])
        more = len(self.index.keys) - len(self.doc)
        if more > 0:
            self.doc, self.has, self.row, self.copies = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.doc, self.has, self.row, self.copies))
        old = at[known]
        better = _greater((has[known], doc[known], row[known]), (self.has[old], self.doc[old], self.row[old]))
        take = np.ones(len(at), bool)
        take[known] = better
        self.copies[at] = np.where(known, self.copies[at], 0) + copies
        self.doc[at[take]], self.has[at[take]], self.row[at[take]] = doc[take], has[take], row[take]

    def drop(self, keys: np.ndarray) -> None:
        self.index.delete(keys)

    def batch(self):
        import pyarrow as pa

        at = np.flatnonzero(self.index.live[:self.index.used])
        return _batch(self.index.keys[at], pa.array(self.doc[at], mask=~self.has[at]), self.row[at], self.copies[at])


def _greater(a: tuple, b: tuple) -> np.ndarray:
    """Row by row: the tuple of ``a`` comes after that of ``b``."""
    out = np.zeros(len(a[0]), bool)
    for x, y in zip(a[::-1], b[::-1]):
        out = (x > y) | ((x == y) & out)
    return out


def combined(keys, doc, has, row, copies):
    """Each digest once, with its best row and the sum of its copies."""
    plain = np.ascontiguousarray(keys).view(f"V{SIZE}").ravel()
    _, group = np.unique(plain, return_inverse=True)
    order = np.lexsort((row, doc, has, group))
    last = np.flatnonzero(np.append(group[order][1:] != group[order][:-1], True)) if len(order) else order
    total = np.add.reduceat(copies[order], np.concatenate([[0], last[:-1] + 1])) if len(order) else copies
    i = order[last]
    return keys[i], doc[i], has[i], row[i], total


def _columns(batch) -> tuple[np.ndarray, ...]:
    keys = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint8).reshape(-1, SIZE)
    doc = batch.column("doc_id")
    return keys, doc.fill_null(0).to_numpy(), np.asarray(doc.is_valid()), batch.column("row").to_numpy(), batch.column("copies").to_numpy()


def _batch(keys: np.ndarray, doc, row: np.ndarray, copies: np.ndarray):
    import pyarrow as pa

    plain = np.ascontiguousarray(keys)
    digest = pa.Array.from_buffers(pa.binary(), len(plain), [None, pa.py_buffer(np.arange(0, SIZE * (len(plain) + 1), SIZE, dtype=np.int32)), pa.py_buffer(plain.tobytes())])
    return pa.RecordBatch.from_arrays([digest, doc, pa.array(row), pa.array(copies)], ["digest", "doc_id", "row", "copies"])


def digests(docs: DataFrame) -> DataFrame:
    """digest, doc_id, row (a number of its own), copies (1) of every row; stored, so that numbers stay."""
    text = F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    own = docs.select(text.alias("digest"), F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.lit(1).cast("bigint").alias("copies"))
    return stored(docs.sparkSession, own, "digests")


def _once(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        keys, doc, has, row, copies = combined(*_columns(batch))
        yield _batch(keys, pa.array(doc, mask=~has), row, copies)


def _sharded(spark, rows: DataFrame) -> DataFrame:
    return rows.repartition(partitions(spark), "digest")


def build(rows: DataFrame) -> DataFrame:
    """The index of rows (digest, doc_id, row, copies): one row per live digest."""

    def run(batches: Iterator) -> Iterator:
        found = _Rows()
        for batch in batches:
            found.add(*_columns(batch))
        yield found.batch()

    return _sharded(rows.sparkSession, rows.mapInArrow(_once, ENTRY)).mapInArrow(run, ENTRY)


def merged(index: DataFrame, more: DataFrame) -> DataFrame:
    """An index with the rows (or the index) ``more`` added."""
    return build(index.unionByName(more.select(*index.columns)))


def withdrawn(index: DataFrame, texts: DataFrame) -> DataFrame:
    """An index without the digests of ``texts`` (column text); what it does not have is passed over.

    Deletions come behind the digests of their shard, whatever the order of rows.
    """
    gone = F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    marks = texts.select(gone.alias("digest"), F.lit(None).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("row"), F.lit(0).cast("bigint").alias("copies"))

    def run(batches: Iterator) -> Iterator:
        found, keys = _Rows(), []
        for batch in batches:
            cols = _columns(batch)
            live = cols[4] > 0
            if live.any():
                found.add(*(c[live] for c in cols))
            keys.append(np.unique(cols[0][~live], axis=0))
        for k in keys:
            found.drop(k)
        yield found.batch()

    rows = index.select("digest", "doc_id", "row", "copies").unionByName(marks.mapInArrow(_once, ENTRY))
    return _sharded(index.sparkSession, rows).mapInArrow(run, ENTRY)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    own = digests(docs)
    index = build(own).select("digest", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("copies").alias("group_size"))
    out = own.join(index, "digest")
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
