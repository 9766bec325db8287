"""Source divergence audit by single-pass in-memory indexing.

Each task reads its documents once and counts (lang, source, term) in memory; when ``BLOCK`` entries are full, the block leaves as
one term-sorted run for each hash shard of (lang, term). A shard merges its runs by a heap, ``FAN`` at a time into longer runs, so
that few are open at once, and gives the frequencies of its terms. Counts of terms in few documents go there.

The frequencies are a table from which the rest is made. A term's share in a group is p = 1 + floor(10^9 (n + 1) / (N + V)); the
pull of a share p on a share q is floor((p - q)^2 / q). Over all terms, pairs of sources mostly meet a share of no occurrence, so a pair's sum
is taken as if all were so (V times one value), plus what each source's own histogram of shares adds, plus corrections, streamed term
by term, only where both sources have it. All values are whole numbers; shares are divided as decimals of 38 digits.

Edge cases: null text, lang and source are ''; each row is a document by itself, whatever its id; a language without kept terms
has pairs of value 0 and no terms; a language with one source has no pairs; very long texts are read in pieces, very long terms
stay whole; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import itertools
import marshal
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepfield.llm.base import byte_view, partitions, spaced, stored

#: Entries (lang, source, term) of a block; entries of a piece of a run; runs merged at a time; pairs corrected at a time.
BLOCK, PIECE, FAN, PAIRS = 400_000, 1 << 14, 64, 1 << 19
DOCUMENTS, RANKS = 3, 200
#: No byte of UTF-8.
BETWEEN = b"\xff"
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

#: A run: its pieces, each a packed list of (key of lang and term, documents, n by source), in order of keys throughout.
Run = list[bytes]


def _packed(entries: list[tuple]) -> bytes:
    import pyarrow as pa

    plain = marshal.dumps(entries)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _entries(run: Run) -> Iterator[tuple]:
    import pyarrow as pa

    for piece in run:
        yield from marshal.loads(pa.decompress(piece[8:], int.from_bytes(piece[:8], "little"), codec="zstd", asbytes=True))


def merged(runs: list[Run]) -> Iterator[tuple]:
    """Entries of sorted runs in order, those of a key summed."""
    last, documents, n = None, 0, {}
    for key, more, part in heapq.merge(*map(_entries, runs), key=itemgetter(0)):
        if key != last:
            if last is not None:
                yield last, documents, n
            last, documents, n = key, more, part
            continue
        documents += more
        for source, many in part.items():
            n[source] = n.get(source, 0) + many
    if last is not None:
        yield last, documents, n


class Runs:
    """The runs of a shard: ``FAN`` of a level are merged into one of the next."""

    def __init__(self):
        self.levels: list[list[Run]] = []

    def add(self, run: Run, level: int = 0) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == FAN:
            longer = merged(self.levels[level])
            self.levels[level] = []
            self.add([_packed(piece) for piece in iter(lambda: list(itertools.islice(longer, PIECE)), [])], level + 1)

    def terms(self) -> Iterator[tuple[str, str, int, dict[str, int]]]:
        """lang, term, documents, n by source, in order."""
        for key, documents, n in merged([r for level in self.levels for r in level]):
            lang, term = key.split(BETWEEN)
            yield lang.decode(), term.decode(), documents, n


class Block:
    """Counts of (lang, source, term), and of the documents that have it."""

    def __init__(self):
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        self.size = 0

    def add(self, lang: str, source: str, text: bytes) -> None:
        group = self.groups.setdefault((lang, source), (Counter(), Counter()))
        before, seen = len(group[0]), set()
        for words in spaced(text, _TABLE):
            group[0].update(words)
            seen.update(words)
        group[1].update(seen)
        self.size += len(group[0]) - before

    def runs(self, shards: int) -> dict[int, list[tuple]]:
        """Sorted entries by shard; the block is empty then."""
        out: dict[int, list[tuple]] = {}
        by: dict[str, dict[bytes, dict[str, int]]] = {}
        documents: dict[str, Counter] = {}
        for (lang, source), (n, seen) in self.groups.items():
            terms = by.setdefault(lang, {})
            for term, many in n.items():
                if term in terms:
                    terms[term][source] = many
                else:
                    terms[term] = {source: many}
            documents.setdefault(lang, Counter()).update(seen)
        self.groups, self.size = {}, 0
        for lang, terms in by.items():
            front = lang.encode() + BETWEEN
            seed, seen = crc32(front), documents[lang]
            for term, n in terms.items():
                out.setdefault(crc32(term, seed) % shards, []).append((front + term, seen[term], n))
        for entries in out.values():
            entries.sort(key=itemgetter(0))
        return out


def frequencies(docs: DataFrame, least: int = DOCUMENTS) -> DataFrame:
    """t (a number of the term), lang, term, source, n, total (n in the lang), first (one row per term has it); stored.

    Terms are in at least ``least`` rows of their lang.
    """
    import pyarrow as pa

    shards = 4 * partitions(docs.sparkSession)

    def invert(batches: Iterator) -> Iterator:
        block = Block()

        def spill():
            for shard, entries in block.runs(shards).items():
                pieces = [_packed(entries[i:i + PIECE]) for i in range(0, len(entries), PIECE)]
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pieces], pa.list_(pa.binary()))], ["shard", "run"])

        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            plain = buf.data
            for lang, source, a, b in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                block.add(lang, source, bytes(plain[a:b]))
                if block.size >= BLOCK:
                    yield from spill()
        yield from spill()

    def merge(batches: Iterator) -> Iterator:
        rows = ((s, r) for batch in batches for s, r in zip(batch.column("shard").to_pylist(), batch.column("run")))
        for shard, own in itertools.groupby(rows, key=lambda r: r[0]):
            runs = Runs()
            for _, run in own:
                runs.add([piece.as_py() for piece in run.values])
            found = ((i, *x) for i, x in enumerate(runs.terms()) if x[2] >= least)
            for some in iter(lambda: list(itertools.islice(found, 4096)), []):
                total = np.repeat([sum(n.values()) for *_, n in some], [len(n) for *_, n in some])
                flat = [((shard << 40) + i, lang, term, source, many, k == 0) for i, lang, term, _, n in some for k, (source, many) in enumerate(n.items())]
                t, lang, term, source, n, first = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(lang, pa.string()), pa.array(term, pa.string()), pa.array(source, pa.string()),
                                                  pa.array(n, pa.int64()), pa.array(total), pa.array(first, pa.bool_())],
                                                 ["t", "lang", "term", "source", "n", "total", "first"])

    packed = _plain(docs).mapInArrow(invert, "shard int, run array<binary>")
    dealt = packed.repartition(partitions(docs.sparkSession), "shard").sortWithinPartitions("shard")
    return stored(docs.sparkSession, dealt.mapInArrow(merge, "t bigint, lang string, term string, source string, n bigint, total bigint, first boolean"), "frequencies")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")))


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(10^9 (n + 1) / (total + terms)), exactly."""
    return F.expr(f"1 + (CAST(1000000000 AS DECIMAL(10,0)) * CAST({n} + 1 AS DECIMAL(20,0))) DIV CAST(greatest({total} + {terms}, 1) AS DECIMAL(20,0))")


def pull(p: str, q: str) -> Column:
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) DIV ({q})")


def totals(docs: DataFrame, found: DataFrame) -> DataFrame:
    """g (a number), lang, source, in_group, in_lang (occurrences of kept terms), terms (kept), p0 (the share of no occurrence) of every group; stored."""
    groups = _plain(docs).select("lang", "source").distinct()
    own = found.groupBy("lang", "source").agg(F.sum("n").alias("in_group"))
    langs = found.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.sum(F.col("first").cast("bigint")).alias("terms"))
    out = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["in_group", "in_lang", "terms"])
    out = out.withColumn("p0", share("0L", "in_group", "terms"))
    return stored(docs.sparkSession, out.withColumn("g", F.monotonically_increasing_id()), "groups")


def _pull(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(g: np.ndarray, o: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, ...]:
    if not len(g):
        return g, o, value
    order = np.lexsort((o, g))
    g, o, value = g[order], o[order], value[order]
    begin = np.flatnonzero(np.append(True, (g[1:] != g[:-1]) | (o[1:] != o[:-1])))
    return g[begin], o[begin], np.add.reduceat(value, begin)


def corrections(shares: DataFrame) -> DataFrame:
    """g, o, value: over the terms that both groups have, what their pull differs by from that of the histograms."""
    import pyarrow as pa

    def correct(t: np.ndarray, g: np.ndarray, p: np.ndarray, p0: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        begin = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        many = np.diff(np.append(begin, len(t)))
        start, size = np.repeat(begin, many), np.repeat(many, many)
        edges, a = np.cumsum(size), 0
        while a < len(t):
            b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + PAIRS, side="right")))
            i = np.repeat(np.arange(a, b), size[a:b])
            first = np.cumsum(size[a:b]) - size[a:b]
            j = np.arange(len(i)) + np.repeat(start[a:b] - first, size[a:b])
            i, j = i[i != j], j[i != j]
            yield _summed(g[i], g[j], _pull(p[i], p[j]) - _pull(p[i], p0[j]) - _pull(p0[i], p[j]) + _pull(p0[i], p0[j]))
            a = b

    def run(batches: Iterator) -> Iterator:
        out, rest = [np.zeros(0, np.int64)] * 3, [np.zeros(0, np.int64)] * 4
        batch_of = lambda x: pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["g", "o", "value"])
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                rest = [np.concatenate([x, batch.column(c).to_numpy()]) for x, c in zip(rest, ("t", "g", "p", "p0"))]
            if not len(rest[0]):
                continue
            # The last term may go on in the next batch.
            end = len(rest[0]) if batch is None else int(np.searchsorted(rest[0], rest[0][-1]))
            if not end:
                continue
            for part in correct(*(x[:end] for x in rest)):
                out = _summed(*(np.concatenate(x) for x in zip(out, part)))
                if len(out[0]) >= PAIRS:
                    yield batch_of(out)
                    out = [np.zeros(0, np.int64)] * 3
            rest = [x[end:] for x in rest]
        yield batch_of(out)

    dealt = shares.select("t", "g", "p", "p0").repartition(partitions(shares.sparkSession), "t").sortWithinPartitions("t")
    return dealt.mapInArrow(run, "g bigint, o bigint, value bigint")


def pair_values(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """g, o, value of all ordered pairs of groups of one lang."""
    x = groups.select("lang", "g", "p0", "terms")
    y = groups.select("lang", F.col("g").alias("o"), F.col("p0").alias("q0"))
    salts = 16
    deal = y.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    base = x.withColumn("salt", F.pmod("g", F.lit(salts)).cast("int")).join(deal, ["lang", "salt"]).filter("g <> o")
    base = base.select("g", "o", (F.col("terms") * pull("p0", "q0")).alias("value"))
    hist = shares.groupBy("lang", "g", "p0", "p").agg(F.count("*").alias("m"))
    met = hist.withColumn("salt", F.pmod(F.xxhash64("g", "p"), F.lit(salts)).cast("int")).join(deal, ["lang", "salt"]).filter("g <> o")
    there = F.struct("g", "o", (F.col("m") * (pull("p", "q0") - pull("p0", "q0"))).alias("value"))
    back = F.struct(F.col("o").alias("g"), F.col("g").alias("o"), (F.col("m") * (pull("q0", "p") - pull("q0", "p0"))).alias("value"))
    sides = met.select(F.explode(F.array(there, back)).alias("s")).select("s.*")
    return base.unionByName(sides).unionByName(corrections(shares)).groupBy("g", "o").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, least: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part, item, value, rank: each source against the others of its lang, and its terms above the lang's share."""
    found = frequencies(docs, least)
    groups = totals(docs, found)
    shares = found.join(groups, ["lang", "source"]).withColumn("p", share("n", "in_group", "terms"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    other = groups.select(F.col("g").alias("o"), F.col("source").alias("item"))
    pairs = pair_values(shares, groups).join(groups.select("g", "lang", "source"), "g").join(other, "o")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by))
    terms = shares.withColumn("q", share("total", "in_lang", "terms")).filter("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), pull("p", "q").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= ranks)
    return pairs.unionByName(terms)
