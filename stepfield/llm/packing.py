"""Best-fit packing of tokenised documents into sequences, planned over the histogram of lengths.

A document is its token ids and one end id. Only a document longer than a sequence is cut, into pieces of a
full sequence each, the first of which may be shorter. The plan looks at counts of lengths only (at most one
row per possible length comes to the driver): longest first, each goes to the fullest sequences that still
have room. The plan is a short table of slots; a piece finds its slot by its rank within its length.

Edge cases: a null or empty text is the end id alone. Rows that share a doc_id (or have none) are documents of
their own. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.base import stored, texts

#: Pieces of a length that are numbered by one task.
RANKED_TOGETHER = 2_000
#: Documents whose ids are held at a time.
TOGETHER = 500


def _bytes_of() -> dict[str, int]:
    """The byte that each visible character of a byte-level vocabulary stands for."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file, run by tiktoken: same vocabulary, merges and ids, about 5 times faster.

    The ids of a byte-level BPE are its merge ranks; the file's special tokens keep their meaning in texts.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    to_byte = _bytes_of()
    ranks = {bytes(to_byte[c] for c in word): i for word, i in spec["model"]["vocab"].items() if word not in special}
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cuts(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)]


def tokenised(docs: DataFrame, path: str, size: int, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, piece, start, length, ids_crc32 (and ids)."""
    import pyarrow as pa

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids

    def run(batches: Iterator) -> Iterator:
        enc = encoder(path)
        for batch in batches:
            for first in range(0, len(batch), TOGETHER):
                yield pieces(batch.slice(first, TOGETHER), enc)

    def pieces(batch, enc):
        columns: list[list] = [[] for _ in range(6)]
        for at, text in enumerate(batch.column("text")):
            ids = np.array([*enc.encode(text.as_py() or "", allowed_special="all"), end_id], "<u4")
            for piece, (start, length) in enumerate(cuts(len(ids), size)):
                part = ids[start:start + length]
                for column, v in zip(columns, (at, piece, start, length, zlib.crc32(part.tobytes()))):
                    column.append(v)
                if keep_ids:
                    columns[5].append(part.astype(np.int32))
        out = [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.int32())]
        out += [pa.array(c, pa.int64()) for c in columns[2:5]]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if keep_ids:
            out, names = [*out, pa.array(columns[5], pa.list_(pa.int32()))], [*names, "ids"]
        return pa.RecordBatch.from_arrays(out, names)

    return texts(docs).mapInArrow(run, schema)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, rank_from, rank_to, wide, sequence, offset) by best fit over counts, longest first.

    Rank r of a length, in [rank_from, rank_to), goes to sequence + (r - rank_from) mod wide, at
    offset + (r - rank_from) div wide * length. Sequences with equal room are kept together as runs, so the
    work and the plan depend on the number of lengths, not of documents.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    slots, opened = [], 0

    def keep(left: int, first: int, n: int) -> None:
        if left not in room:
            bisect.insort(rooms, left)
            room[left] = []
        room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                new = -(-todo // (size // length))
                keep(size, opened, new)
                opened += new
                continue
            left = rooms[at]
            first, n = room[left].pop()
            if not room[left]:
                del room[left], rooms[at]
            each = min(todo, left // length)
            wide = min(n, todo // each)
            slots.append((length, rank, rank + wide * each, wide, first, size - left))
            rank, todo = rank + wide * each, todo - wide * each
            if left - each * length:
                keep(left - each * length, first, wide)
            if wide < n:
                keep(left, first + wide, n - wide)
    return slots


def packed(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (stored: they are read three times) with sequence_id and offset."""
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    slots = spark.createDataFrame(plan(counts, size), "length bigint, low bigint, high bigint, wide bigint, first bigint, at bigint")
    # The rank within a length: numbered per salt, after the counts of the salts before it. A length has as many
    # salts as it has rows for (a list with one entry per possible length).
    salts = F.lit([-(-counts.get(k, 1) // RANKED_TOGETHER) for k in range(size + 1)])
    own = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.get(salts, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = own.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    own = own.withColumn("n", F.row_number().over(order) - 1).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("n"))
    slots = slots.withColumnRenamed("length", "_length")
    own = own.join(slots, (own["length"] == slots["_length"]) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    step = F.col("rank") - F.col("low")
    return own.select(*pieces.columns, (F.col("first") + step % F.col("wide")).alias("sequence_id"),
                      (F.col("at") + F.floor(step / F.col("wide")) * F.col("length")).cast("bigint").alias("offset"))


def pack(docs: DataFrame, path: str, size: int = 2048, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id, offset of every piece."""
    return packed(stored(docs.sparkSession, tokenised(docs, path, size, end_id, keep_ids), "pieces"), size)
