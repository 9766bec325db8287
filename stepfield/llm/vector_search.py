"""Exact top-k inner products by a vector-approximation file.

Vectors are integers floor(256 x). The file has two parts: quantised cells (a byte per component) and the exact
vectors, in blocks of rows. A scan of the cells gives every candidate an upper and a lower bound for every query
of a block of queries; exact vectors are then read in the order of their upper bounds until the kth best exact
score is at least every bound not yet read. Each block of candidates meets each block of queries once: a group holds some blocks
of both (``GROUP`` bytes of each), and only k rows for each query leave it.

Edge cases: vectors that are null, empty or hold null or non-finite components take no part, neither as query
nor as candidate; vectors of different length don't meet. Rows that share a vec_id are candidates of their own, and
none of them is a candidate of its own id; a query id that is repeated is answered for the least of its
vectors. Rows without vec_id take no part. A component of 2^53 or more (as an integer), or a pair whose products add up to
2^53 or more in size, can't be scored exactly and stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.base import partitions, stored

#: Cells of a component, rows of a block of candidates and of queries, exact vectors read at a time.
CELLS, BLOCK, QUERIES, STEP = 64, 2048, 512, 16
#: Bytes of the file, and of the queries, that one group holds (some more, where hashing deals the blocks unevenly).
GROUP = 64 << 20
#: Doubles hold whole numbers below this one exactly.
EXACT = 2.0 ** 53


def _integer(c: Column) -> Column:
    scaled = 256 * c.cast("double")
    far = F.raise_error(F.lit("a component of 2^53 or more can't be scored exactly")).cast("long")
    return F.when(F.abs(scaled) < EXACT, F.floor(scaled).cast("long")).otherwise(far)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, v: the integer vectors that take part."""
    x = F.col("embedding")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & good).select(
        "vec_id", F.size(x).alias("dim"), F.transform(x, _integer).alias("v"))


def _matrix(batch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """dim, ids, exact (packed int64), low and wide (of each component's cells), cells (packed bytes): ``size`` rows at most in each."""
    import pyarrow as pa

    schema = "dim int, ids binary, exact binary, low binary, wide binary, cells binary"

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                ids, v = part.column("vec_id").to_numpy().astype(np.int64), _matrix(part, dim)
                for a in range(0, len(ids), size):
                    own = v[a:a + size]
                    low = own.min(0)
                    wide = (own.max(0) - low) // CELLS + 1
                    cells = ((own - low) // wide).astype(np.uint8)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([dim], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (ids[a:a + size], own, low, wide, cells)],
                        ["dim", "ids", "exact", "low", "wide", "cells"])

    return rows.mapInArrow(run, schema)


def best_of_block(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, exact: np.ndarray, low: np.ndarray, wide: np.ndarray,
                  cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vec_id, score) of each query's k best in a block; ties to smaller ids."""
    size, other = np.abs(q.astype(np.float64)), np.abs(exact.astype(np.float64))
    if size.max(0, initial=0) @ other.max(0, initial=0) >= EXACT:
        most = size @ other.T
        most[q_ids[:, None] == ids[None, :]] = 0
        if most.max(initial=0) >= EXACT:
            raise OverflowError("a score of 2^53 or more can't be exact")
    # A component's integer lies in [low + cell * wide, low + cell * wide + wide - 1].
    corner = low + cells.astype(np.float64) * wide
    reach = wide - 1.0
    base = q.astype(np.float64) @ corner.T
    upper = base + (np.maximum(q, 0) @ reach)[:, None]
    upper[q_ids[:, None] == ids[None, :]] = -np.inf
    order = np.argsort(-upper, axis=1, kind="stable")
    many = np.isfinite(upper).sum(1)
    value = exact.astype(np.float64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    active, read = np.arange(len(q)), STEP
    while len(active):
        read = min(read, len(ids))
        took = order[active, :read]
        score = np.einsum("qd,qrd->qr", q[active].astype(np.float64), value[took])
        score[np.arange(read)[None, :] >= many[active][:, None]] = -np.inf
        rank = np.lexsort((ids[took], -score), axis=1)[:, :k]
        best = np.take_along_axis(score, rank, 1)
        kth = best[:, -1] if best.shape[1] == k else np.full(len(active), -np.inf)
        rest = upper[active, order[active, read]] if read < len(ids) else np.full(len(active), -np.inf)
        sure = (rest < kth) | (rest == -np.inf)
        got = np.isfinite(best[sure])
        row = np.broadcast_to(active[sure][:, None], got.shape)
        out.append((row[got], np.take_along_axis(ids[took], rank, 1)[sure][got], best[sure][got]))
        active, read = active[~sure], read * 2
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out))


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors (vec_id, embedding) for each query, its own id left out."""
    import pyarrow as pa

    spark = vectors.sparkSession
    file = stored(spark, blocks(integers(vectors), BLOCK), "va-file")
    asked = integers(queries).groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    asked = stored(spark, blocks(asked, QUERIES), "va-queries").select(
        "dim", F.col("ids").alias("q_ids"), F.col("exact").alias("q"))
    # A grid of groups: file blocks are dealt to its rows, query blocks to its columns, and each block goes along its row or column.
    blocks_in, held = file.agg(F.count("*"), F.sum(F.length("exact") + F.length("cells"))).first()
    wanted = asked.agg(F.sum(F.length("q"))).first()[0]
    down = max(1, -(-(held or 0) // GROUP), min(partitions(spark), blocks_in))
    across = max(1, -(-(wanted or 0) // GROUP))
    dealt = lambda ids, n: F.pmod(F.xxhash64(ids), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    file = file.withColumn("down", dealt("ids", down)).withColumn("across", every(across))
    asked = asked.withColumn("across", dealt("q_ids", across)).withColumn("down", every(down))
    names = ["query_id", "vec_id", "score"]

    def run(own: pa.Table, queries: pa.Table) -> pa.Table:
        take = lambda r, name, kind: np.frombuffer(r[name].as_py(), kind)
        rows = lambda t: [{n: t.column(n)[i] for n in t.column_names} for i in range(t.num_rows)]
        out = [np.zeros((0, 3), np.int64)]
        for a in rows(queries):
            dim, q_ids = a["dim"].as_py(), take(a, "q_ids", np.int64)
            q, best = take(a, "q", np.int64).reshape(-1, dim), np.zeros((0, 3), np.int64)
            for r in rows(own):
                row, vec, score = best_of_block(
                    q, q_ids, take(r, "ids", np.int64), take(r, "exact", np.int64).reshape(-1, dim),
                    take(r, "low", np.int64), take(r, "wide", np.int64), take(r, "cells", np.uint8).reshape(-1, dim), k)
                best = np.concatenate([best, np.stack([q_ids[row], vec, score.astype(np.int64)], 1)])
                best = best[np.lexsort((best[:, 1], -best[:, 2], best[:, 0]))]
                first = np.searchsorted(best[:, 0], best[:, 0])
                best = best[np.arange(len(best)) - first < k]
            out.append(best)
        found = np.concatenate(out)
        return pa.table([pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)], names)

    keys = ["dim", "down", "across"]
    found = file.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
