"""SimHash near-duplicates: fingerprints, a byte-position inverted index with count filtering, components.

A text's words ``[^\\x20\\x09-\\x0D]+`` (A-Z lower-cased) give 3-word shingles, repeats included, joined by a
space; fewer words are one shingle. Each shingle is hashed with XXH64 (UTF-8, seed 42); a bit of the fingerprint
is 1 if it is set in more than half of the hashes. Two fingerprints are linked at ``NEAR`` differing bits or fewer.

Two linked fingerprints differ in at most NEAR bytes, so they share at least 8 - NEAR positional bytes. Lists
for single bytes would each hold a 256th of everything; postings are therefore kept for sets of byte positions,
chosen so that any two linked fingerprints share a whole list. Within a list the shared positional bytes of a
pair are tallied, pairs below the guaranteed number go, and the rest are verified bit by bit. Only distinct
fingerprints are indexed, so copies never multiply pairs.

Edge cases: null, empty and blank texts have fingerprint zero and are linked like any other. Rows that share a
doc_id each have their own fingerprint and component. A row without doc_id is linked too, but names no
component: the smallest id of its component does (null, if none has one).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import keyed, stored
from stepfield.operators.graph import components

SHINGLE, SEED, NEAR = 3, 42, 2


def fingerprint(text: bytes, n: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    plain = b" ".join(words)
    if len(words) <= n:
        return xxhash.xxh64_intdigest(plain, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    many = len(words) - n + 1
    total = np.zeros(64, np.int64)
    for a in range(0, many, 1 << 14):  # a long text takes no more memory than a short one
        b = min(many, a + (1 << 14))
        h = [digest(plain[s:e], SEED) for s, e in zip(starts[a:b].tolist(), ends[a + n - 1:b + n - 1].tolist())]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > many, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = SHINGLE) -> DataFrame:
    """doc_id, sig (a hash of the text), fp (the bits as a long)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            fp = np.array([fingerprint((t.as_py() or "").encode(), n) for t in batch.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sig"), pa.array(fp)], ["doc_id", "sig", "fp"])

    return keyed(docs).mapInArrow(run, f"doc_id {kind}, sig bigint, fp bigint")


def lists(near: int) -> list[int]:
    """Masks of byte positions such that, whichever ``near`` bytes differ, some mask has none of them.

    Chosen greedily: each next mask leaves out the set of near + 1 positions that settles most open cases.
    """
    open_cases = set(itertools.combinations(range(8), near))
    out = []
    while open_cases:
        left_out = max(itertools.combinations(range(8), near + 1), key=lambda s: len(open_cases & set(itertools.combinations(s, near))))
        open_cases -= set(itertools.combinations(left_out, near))
        mask = sum(0xFF << 8 * i for i in range(8) if i not in left_out)
        out.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return out


def shared_bytes(x: Column) -> Column:
    """Zero bytes of a difference."""
    zero = [F.when(x.bitwiseAND(F.lit(0xFF << 8 * i if i < 7 else -(1 << 56)).cast("long")) == 0, 1).otherwise(0) for i in range(8)]
    return sum(zero[1:], zero[0])


def links(distinct: DataFrame, near: int = NEAR) -> DataFrame:
    """Pairs src < dst of distinct fingerprints (fp) at most ``near`` bits apart, some more than once."""
    keys = [F.struct(F.lit(i).alias("list"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bytes")) for i, m in enumerate(lists(near))]
    index = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.list", "k.bytes", "fp")
    a, b = index.withColumnRenamed("fp", "src"), index.withColumnRenamed("fp", "dst")
    x = F.col("src").bitwiseXOR(F.col("dst"))
    same = (a["list"] == b["list"]) & (a["bytes"] == b["bytes"]) & (F.col("src") < F.col("dst"))
    return a.join(b, same & (shared_bytes(x) >= 8 - near) & (F.bit_count(x) <= near)).select("src", "dst")


def near_duplicates(docs: DataFrame, n: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """doc_id, sig (a hash of the text), fingerprint (16 hex digits), component_id of every row."""
    own = stored(docs.sparkSession, fingerprints(docs, n), "fingerprints")
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    label = components(links(distinct.select("fp"), near).distinct()).select(F.col("node").alias("fp"), F.col("component").alias("c"))
    known = distinct.join(label, "fp", "left").withColumn("c", F.coalesce("c", "fp"))
    least = known.groupBy("c").agg(F.min("first").alias("component_id"))
    classes = known.join(least, "c").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return own.join(classes, "fp").select("doc_id", "sig", text.alias("fingerprint"), "component_id")

