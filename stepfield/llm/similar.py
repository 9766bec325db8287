"""Near-duplicates by word shingles, for the pipeline: SimHash links, then the positional byte index over bytes that reach similarity 0.8.

First every text has its SimHash fingerprint, and texts whose fingerprints ``simhash`` links are verified. At a similarity of 0.8 (shared part of the 5-word shingle sets of two texts) some ten of 64 SimHash bits differ, in any of the bytes,
so no shared byte is guaranteed. For those pairs the index is used once more, with ``POSITIONS`` bytes that agree as often as shingles do: byte i is from the least
of the shingles' i-th hashes. Postings are lists for ``TOGETHER`` positions; the shared positional bytes of a pair that meets in a list are
tallied, pairs below ``SHARED`` go, and the rest is verified on the hashed shingle sets of the whole texts. Of pairs at
0.8, 98.5 % meet in a list and 99.6 % of these reach the count.

Copies (equal word sequences, A-Z lower-cased) are one class throughout. Groups whose texts share most are found first, with few pairs: the classes of a
list are verified against the one whose lists are the fullest; in the next round the groups found so far meet in each list by such members, until a round
links nothing. Then every two classes of different groups that can reach the similarity are verified (``apart``), among all classes that share a list or have linked
fingerprints: no link between groups is left out, and those within a group change nothing. A group has one row of its own that stays: that of the smallest doc_id.

Edge cases: null, empty and blank texts are copies of each other; fewer than five words are one shingle; rows that share a doc_id are told apart
by their text; of rows equal in both, one stays; a row without doc_id stays only where no row of its group has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.base import byte_view, mix64, slabs, stored
from stepfield.llm.repeats import slice_hashes
from stepfield.llm.simhash import fingerprint, shared_bytes
from stepfield.llm.simhash import links as near_fingerprints
from stepfield.operators.graph import components

SHINGLE, LEAST = 5, 0.8
POSITIONS, TOGETHER, SHARED = 32, 4, 19
SLAB, _PART, _TOKENS = 1 << 19, 1 << 13, 1 << 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_TURN = mix64(np.arange(1, POSITIONS + 1, dtype=np.uint64) * _BASE) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> Iterator[tuple[np.ndarray, int]]:
    """Of each text the hashes of its n-word shingles, sorted, each once, and a hash of its word sequence."""
    whole = buf[offsets[0]:offsets[-1]].tobytes().lower()
    words, counts = [], []
    for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist()):
        own = whole[a:b].split()
        words += own
        counts.append(len(own))
    plain = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1]) if words else ends
    word = slice_hashes(plain, begins, ends) if words else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(counts)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        own = word[a:b]
        place = mix64(np.arange(1, len(own) + 1, dtype=np.uint64) * _BASE)
        copy = int(np.bitwise_xor.reduce(mix64(own * (place | np.uint64(1)) + place)) if len(own) else 0)
        if len(own) < n:
            yield np.array([copy], np.uint64), copy
            continue
        h = own[:len(own) - n + 1].copy()
        for k in range(1, n):
            h = mix64(h * _BASE + own[k:len(own) - n + 1 + k])
        yield np.unique(h), copy


def positional(h: np.ndarray) -> np.ndarray:
    """POSITIONS bytes of a shingle set."""
    least = np.full(POSITIONS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for a in range(0, len(h), _PART):
        least = np.minimum(least, (h[a:a + _PART, None] * _TURN ^ (h[a:a + _PART, None] >> np.uint64(29)) * _TURN).min(0))
    return (mix64(least) >> np.uint64(56)).astype(np.uint8)


def _sets(own: DataFrame, n: int, with_set: bool) -> DataFrame:
    """doc_id, sig, copy (a hash of the word sequence) of rows (doc_id, sig, text), and fp0 to fp3 and simhash, or set (32-bit hashes, packed)."""
    import pyarrow as pa

    names = ["doc_id", "sig", "copy", *(["set"] if with_set else ["fp0", "fp1", "fp2", "fp3", "simhash"])]

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            found = [x for a, b in slabs(offsets, SLAB) for x in shingles(buf, offsets[a:b + 1], n)]
            copy = pa.array(np.array([c for _, c in found], np.uint64).view(np.int64))
            if with_set:
                more = [pa.array([np.unique((h >> np.uint64(32)).astype(np.uint32)).tobytes() for h, _ in found], pa.binary())]
            else:
                fp = np.array([positional(h) for h, _ in found], np.uint8).reshape(-1, POSITIONS).view("<i8")
                more = [pa.array(np.ascontiguousarray(fp[:, k])) for k in range(fp.shape[1])]
                more.append(pa.array(np.array([fingerprint((t.as_py() or "").encode(), n) for t in batch.column("text")], np.uint64).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), copy, *more], names)

    kind = own.schema["doc_id"].dataType.simpleString()
    tail = "set binary" if with_set else "fp0 bigint, fp1 bigint, fp2 bigint, fp3 bigint, simhash bigint"
    return own.select("doc_id", "sig", "text").mapInArrow(run, f"doc_id {kind}, sig bigint, copy bigint, {tail}")


def _shared(a: str, b: str) -> Column:
    return sum((shared_bytes(F.col(f"{a}.fp{k}").bitwiseXOR(F.col(f"{b}.fp{k}"))) for k in range(1, 4)), shared_bytes(F.col(f"{a}.fp0").bitwiseXOR(F.col(f"{b}.fp0"))))


def postings(classes: DataFrame) -> DataFrame:
    """list, bytes, copy, fp (a struct): each class under its lists."""
    halves = [F.struct(F.lit(2 * k + half).alias("list"), F.shiftrightunsigned(F.col(f"fp{k}"), 32 * half).bitwiseAND(F.lit(0xFFFFFFFF)).alias("bytes"))
              for k in range(POSITIONS // 8) for half in range(2)]
    return classes.select("copy", F.struct("fp0", "fp1", "fp2", "fp3").alias("fp"), F.explode(F.array(*halves)).alias("k")).select("k.list", "k.bytes", "copy", "fp")


def simhash_pairs(own: DataFrame) -> DataFrame:
    """src, dst: classes (copy, simhash) by their fingerprints; each with the first of its fingerprint, and the first ones of linked fingerprints."""
    classes = own.select("copy", "simhash").distinct()
    first = classes.groupBy(F.col("simhash").alias("fp")).agg(F.min("copy").alias("first"))
    same = classes.join(first, F.col("simhash") == F.col("fp")).filter(F.col("copy") != F.col("first")).select(F.col("first").alias("src"), F.col("copy").alias("dst"))
    a, b = (first.select(F.col("fp").alias(n), F.col("first").alias(m)) for n, m in (("src", "a"), ("dst", "b")))
    near = near_fingerprints(first.select("fp")).distinct().join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return same.unionByName(near)


def candidates(met: DataFrame, group: DataFrame | None) -> DataFrame:
    """src, dst: in each list the first class of every group, with the first class of all, where they share enough bytes.

    First are classes whose lists are the fullest (``rank``): the text that others were made from shares lists with most of them.
    """
    own = met if group is None else met.join(group, "copy", "left").withColumn("label", F.coalesce("label", "copy"))
    own = own.withColumn("label", F.col("copy")) if group is None else own
    first = own.groupBy("list", "bytes", "label").agg(F.min(F.struct("rank", "copy", "fp")).alias("a"))
    head = first.groupBy("list", "bytes").agg(F.min("a").alias("b"), F.count("*").alias("many")).filter("many > 1").drop("many")
    pairs = first.join(head, ["list", "bytes"]).filter(F.col("a.copy") != F.col("b.copy"))
    return pairs.filter(_shared("a.fp", "b.fp") >= SHARED).select(F.col("a.copy").alias("src"), F.col("b.copy").alias("dst")).distinct()


def _tokens(sets: DataFrame) -> DataFrame:
    """copy, size (of the set), token: one row per hash of each set."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            buf, offsets = byte_view(batch.column("set"))
            copy = np.asarray(batch.column("copy"))
            for a, b in slabs(offsets, _TOKENS):
                size = np.diff(offsets[a:b + 1]) // 4
                token = np.frombuffer(buf[offsets[a]:offsets[b]].tobytes(), np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(copy[a:b], size)), pa.array(np.repeat(size, size).astype(np.int32)), pa.array(token)], ["copy", "size", "token"])

    return sets.select("copy", "set").mapInArrow(run, "copy bigint, size int, token int")


def apart(sets: DataFrame, label: DataFrame | None, least: float = LEAST) -> DataFrame:
    """src, dst: every two classes of different groups whose sets can share ``least``, by their rarest hashes.

    Two such sets have one of the first ``size - least * size + 1`` hashes of each in common, in any order that is the same for all sets. First
    come hashes of one group only, which no pair needs, then rare ones; so what most texts of a crowd have in common hardly meets.
    The places of a common hash bound what the sets can share.
    """
    own = _tokens(sets)
    own = own.withColumn("label", F.col("copy")) if label is None else own.join(label, "copy", "left").withColumn("label", F.coalesce("label", "copy"))
    common = own.groupBy("token").agg(F.count("*").alias("many"), F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("token", "many")
    met = own.join(common, "token")
    of = Window.partitionBy("copy")
    place = F.col("size") - F.count("*").over(of) + F.row_number().over(of.orderBy("many", "token"))
    need = F.ceil(least * F.col("size") - 1e-6)
    first = met.withColumn("place", place).filter(F.col("place") <= F.col("size") - need + 1)
    a, b = (first.select("token", *(F.col(c).alias(f"{c}_{n}") for c in ("copy", "label", "size", "place"))) for n in "ab")
    most = F.least("place_a", "place_b") + F.least(F.col("size_a") - F.col("place_a"), F.col("size_b") - F.col("place_b"))
    enough = most >= least / (1 + least) * (F.col("size_a") + F.col("size_b")) - 1e-6
    met = a.join(b, "token").filter((F.col("copy_a") < F.col("copy_b")) & (F.col("label_a") != F.col("label_b")) & enough)
    return met.select(F.col("copy_a").alias("src"), F.col("copy_b").alias("dst")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float = LEAST) -> DataFrame:
    """The pairs whose sets share ``least`` or more."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("a"), batch.column("b")):
                x, y = (np.frombuffer(v.as_py(), np.uint32) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst")], ["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    one, two = sets.select(F.col("copy").alias("src"), F.col("set").alias("a")), sets.select(F.col("copy").alias("dst"), F.col("set").alias("b"))
    return pairs.join(one, "src").join(two, "dst").select("src", "dst", "a", "b").mapInArrow(run, "src bigint, dst bigint")


def groups(docs: DataFrame, n: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """doc_id, sig (a hash of the text), label of the group of every row."""
    spark = docs.sparkSession
    text = docs.select("doc_id", F.xxhash64("text").alias("sig"), F.coalesce("text", F.lit("")).alias("text"))
    own = stored(spark, _sets(text, n, False), "positions")
    classes = own.groupBy("copy").agg(*(F.min(f"fp{k}").alias(f"fp{k}") for k in range(4)))
    index = postings(classes)
    busy = index.groupBy("list", "bytes").agg(F.count("*").alias("many")).filter("many > 1")
    met = index.join(busy, ["list", "bytes"])
    rank = met.groupBy("copy").agg((-F.sum("many")).alias("rank"))
    met = stored(spark, met.drop("many").join(rank, "copy"), "postings")
    pairs = stored(spark, simhash_pairs(own), "simhash-pairs")
    # Sets are made for one row of each class that meets another.
    meets = met.select("copy").unionByName(pairs.select(F.col("src").alias("copy"))).unionByName(pairs.select(F.col("dst").alias("copy"))).distinct()
    chosen = own.join(meets, "copy", "left_semi").groupBy("copy").agg(F.min(F.struct("doc_id", "sig")).alias("r"))
    chosen = chosen.select(F.col("r.doc_id").alias("d"), F.col("r.sig").alias("s"))
    picked = text.join(chosen, text.doc_id.eqNullSafe(chosen.d) & (text.sig == chosen.s), "left_semi")
    sets = stored(spark, _sets(picked, n, True).select("copy", "set").dropDuplicates(["copy"]), "sets")
    links, tested, label = stored(spark, verified(pairs, sets, least), "links"), pairs, None
    found, whole = links, False
    while True:
        new = bool(found.take(1))
        if new:
            links = links if found is links else links.unionByName(found)
            label = components(links).select(F.col("node").alias("copy"), F.col("component").alias("label"))
        if whole:
            break
        # Rounds of few pairs until one links nothing, then all pairs that are still apart: what these link needs no further round.
        whole = not new and tested is not pairs
        pairs = apart(sets, label, least) if whole else candidates(met, label)
        pairs = stored(spark, pairs.join(tested, ["src", "dst"], "left_anti"), "pairs")
        found = stored(spark, verified(pairs, sets, least), "links")
        tested = tested.unionByName(pairs)
    if label is None:
        return own.select("doc_id", "sig", F.col("copy").alias("label"))
    return own.join(label, "copy", "left").select("doc_id", "sig", F.coalesce("label", "copy").alias("label"))


def one_of_each(docs: DataFrame, n: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """One row of each group of ``docs``: that of the smallest doc_id (without any, of the smallest text hash)."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "sig")
    stay = groups(docs, n, least).groupBy("label").agg(F.min(order).alias("r")).select(F.col("r.doc_id").alias("d"), F.col("r.sig").alias("s")).distinct()
    own = docs.withColumn("_sig", F.xxhash64("text"))
    own = own.join(stay, own.doc_id.eqNullSafe(stay.d) & (own["_sig"] == stay.s), "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", "_sig").orderBy("doc_id"))
    return own.withColumn("_n", once).filter(F.col("_n") == 1).select(*docs.columns)
