"""The common frame of the two operators that remove text repeated from documents with smaller ids.

A window of ``n`` symbols (words or bytes) repeats if it also starts in a document with a smaller id. The suffixes
that could matter are thinned out first, without loss: of the k-symbol grams in a window the one with the least
hash is its anchor, so two equal windows have equal anchors at equal places, and only anchors are looked at.

1. ``sieve``: anchors, combined per task, are dealt by their hash; those of one document only go.
2. ``contexts``: each document gets its remaining anchors back and sends, for each, the symbols around it. Equal
   contexts of a batch are sent once, for the smallest id; the other copies are settled on the spot. A hot
   passage thus leaves a task once, however many documents hold it.
3. ``settle`` (the operator's own core) works on the contexts that share a prefix, at most ``CROWD`` of them. An anchor
   that stands at more places sends no contexts: each window that has it as its anchor goes out as a 128-bit
   fingerprint with the smallest id of the batch, and is compared with its equals only.
4. The spans found go back to their documents.

Before all that, texts that a smaller document has whole, told by a 128-bit hash, are set apart: they lose all their windows
and witness nothing that the first copy does not.

Rows are packed as arrays, one row per batch and bucket, so shuffles move few rows and no group is gathered
beyond its bucket. Documents are known by doc_id and a hash of id and text: rows with one id and different texts
stay apart. Rows without doc_id neither lose text nor count as earlier copies.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import byte_view, mix64, partitions, slabs, stored

#: Documents' bytes worked on at a time; places of an anchor beyond which it is crowded.
SLAB, CROWD = 1 << 19, 4096
#: Documents of a batch beyond which an anchor is crowded at once, so that they need not meet those of other batches.
LOCAL = 256
#: Slabs that are combined before rows leave a task, and entries that are settled at a time.
TOGETHER, SETTLED = 32, 1 << 14
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Symbols:
    """A slab of texts as symbols: gram hashes by place, the places where each text begins, and ways to cut contexts."""

    #: Symbols of an anchor: the fewer, the more of them recur by chance in a larger corpus; the more, the more anchors there are.
    K = 16

    def __init__(self, grams: np.ndarray, starts: np.ndarray):
        #: Hash of the K symbols from each place (NONE where the text ends before), n + 1 starts of texts.
        self.grams, self.starts = grams, starts

    def prints(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Two fingerprints of the symbols from first to last (not included; both rise)."""
        raise NotImplementedError

    def cut(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the symbols from first to last (not included), packed, their n + 1 offsets, two fingerprints of each."""
        raise NotImplementedError


_BASE = 0x9E3779B97F4A7C15
_VALUES = [mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(seed)) for seed in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
_POWERS: list[np.ndarray] = []


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of slices of bytes (starts and ends rise): polynomials modulo 2^64 from running sums.

    About ``SLAB`` bytes are summed at a time; a slice may be longer.
    """
    out, a = np.zeros(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + SLAB, side="right")))
        base, part = start[a], data[start[a]:end[b - 1]]
        if not _POWERS or len(_POWERS[0]) <= len(part):
            n = max(2 * SLAB, len(part))
            _POWERS[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_VALUES[which][part] * _POWERS[0][:len(part)], out=total[1:])
        i, k = start[a:b] - base, end[a:b] - base
        out[a:b] = mix64((total[k] - total[i]) * _POWERS[1][i] + (k - i).astype(np.uint64))
        a = b
    return out


def _slide(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick over x[i:i+width] for each i that has all of them."""
    have = 1
    while have * 2 <= width:
        x = pick(x[:-have], x[have:])
        have *= 2
    return pick(x[:len(x) - (width - have)], x[width - have:]) if have < width else x


def anchors(grams: np.ndarray, starts: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places that are the least gram (of k symbols) of some window of n symbols inside one text."""
    w = n - k + 1
    if len(grams) < n:
        return np.zeros(0, np.int64)
    rank = (grams >> np.uint64(32)).astype(np.uint32)
    least = _slide(rank, w, np.minimum)
    # Windows that begin too late in their text to be inside it count as 0, which no gram is.
    for_start = np.zeros(len(grams) + w - 1, np.uint32)
    inside = np.zeros(len(grams) + 1, np.int32)
    long = np.flatnonzero(np.diff(starts) >= n)
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long + 1] - n + 1, -1)
    ok = np.cumsum(inside[:-1])[:len(least)] > 0
    for_start[w - 1:w - 1 + len(least)] = np.where(ok, np.maximum(least, 1), 0)
    most = _slide(for_start, w, np.maximum)
    return np.flatnonzero((most == np.maximum(rank, 1)) & (grams != NONE))


def windows(s: Symbols, at: np.ndarray, n: int) -> np.ndarray:
    """Places, in order, of the windows of n symbols inside one text that have one of the grams ``at`` as their anchor."""
    if not len(at):
        return np.zeros(0, np.int64)
    rank = (s.grams >> np.uint64(32)).astype(np.uint32)
    own = np.full(len(rank), 0xFFFFFFFF, np.uint32)
    own[at] = rank[at]
    place = np.flatnonzero(_slide(rank, n - s.K + 1, np.minimum) == _slide(own, n - s.K + 1, np.minimum))
    return place[place + n <= s.starts[np.searchsorted(s.starts, place, side="right")]]


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of known kinds, each behind its length; compressed."""
    import pyarrow as pa

    plain = b"".join(np.int64(a.nbytes).tobytes() + a.tobytes() for a in arrays)
    return np.int64(len(plain)).tobytes() + pa.Codec("zstd", compression_level=6).compress(plain, asbytes=True)


def _unpack(data: bytes, *kinds) -> list[np.ndarray]:
    import pyarrow as pa

    data = pa.decompress(data[8:], int(np.frombuffer(data, np.int64, 1)[0]), codec="zstd", asbytes=True)
    out, at = [], 0
    for kind in kinds:
        size = int(np.frombuffer(data, np.int64, 1, at)[0])
        out.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def runs_of(sorted_keys: np.ndarray) -> np.ndarray:
    """True where a run of equal keys begins."""
    new = np.ones(len(sorted_keys), bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return new


def least_in_run(new: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each element's run."""
    if not len(value):
        return value
    return np.minimum.reduceat(value, np.flatnonzero(new))[np.cumsum(new) - 1]


#: Flags of sieve entries: asks whether others exist; bears witness to others; is known to be repeated, or even crowded.
ASKS, WITNESS, KNOWN, TOLD = 1, 2, 4, 8


def identified(docs: DataFrame, keep: list[str]) -> DataFrame:
    """doc_id, uid, text, rest: uid tells rows with one id and different texts apart, rest has the columns to keep."""
    rest = F.struct(*(keep or ["doc_id"]))  # never a constant, which only some plans would fold away
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("uid"), F.coalesce("text", F.lit("")).alias("text"), rest.alias("rest"))


def sieve(own: DataFrame, symbols: Callable, n: int, buckets: int) -> DataFrame:
    """uid, hs: of each document the anchors (short hashes) that another document has too; odd ones are crowded.

    A short hash that fits another anchor of the document as well only sends a context too many, as what both flags fit
    is sent in both ways.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    def split(batches: Iterator) -> Iterator:
        for batch in batches:
            batch = batch.filter(pc.and_(pc.is_valid(batch.column("doc_id")), pc.is_null(batch.column("late_uid"))))
            buf, offsets = byte_view(batch.column("text"))
            uids = batch.column("uid").to_numpy()
            for some in _groups(slabs(offsets, SLAB)):
                yield from combined(buf, offsets, uids, some)

    def combined(buf, offsets, uids, some) -> Iterator:
        hs, docs = [], []
        for a, b in some:
            s = symbols(buf, offsets[a:b + 1])
            at = anchors(s.grams, s.starts, n, s.K)
            hs.append(s.grams[at])
            docs.append(np.searchsorted(s.starts, at, side="right") - 1 + a)
        h, doc = mix64(np.concatenate(hs)) & ~np.uint64(1), np.concatenate(docs).astype(np.uint32)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        once = runs_of(h)
        places = np.diff(np.append(np.flatnonzero(once), len(h)))
        once[1:] |= doc[1:] != doc[:-1]
        h, doc = h[once], doc[once]
        new = runs_of(h)
        run = np.cumsum(new) - 1
        many = np.diff(np.append(np.flatnonzero(new), len(h)))[run]
        flag = np.where(many == 1, ASKS | WITNESS, np.where(new, KNOWN | WITNESS, KNOWN)).astype(np.uint8)
        # The places of a hash in the batch go along with its first document and tell whether it is crowded.
        count = np.where(new, np.where(many > LOCAL, 65535, np.minimum(places[run], 65535)), 0).astype(np.uint16)
        bucket = _spot(h, buckets) >> np.uint64(32)
        # Of a hash that is crowded already, one entry says so to the others; the rest is spread by document.
        told = (many > LOCAL) & ~new
        flag[told] = TOLD
        bucket[told] = mix64(uids[doc[told]].view(np.uint64)) % np.uint64(buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        keys, rows = [], []
        for k in np.flatnonzero(np.diff(edges)):
            part = order[edges[k]:edges[k + 1]]
            used, local = np.unique(doc[part], return_inverse=True)
            keys.append(k)
            # Within a bucket 31 bits are enough: two anchors taken for one have one flag and only send contexts in vain.
            rows.append(_pack(_steps(_short(h[part], buckets)), local.astype(np.uint32 if len(used) > 65535 else np.uint16), flag[part], count[part], uids[used].astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "entries"])

    def meet(batches: Iterator) -> Iterator:
        hs, uid, flags, counts = [], [], [], []
        for batch in batches:
            for row in batch.column("entries"):
                data = row.as_py()
                short, local, flag, count, used = _sieve_parts(data)
                hs.append(short)
                uid.append(used[local])
                flags.append(flag)
                counts.append(count)
        if not hs:
            return
        h, u, f, c = (np.concatenate(x) for x in (hs, uid, flags, counts))
        told = (f & TOLD) > 0
        yield pa.RecordBatch.from_arrays([pa.array(u[told]), pa.array((h[told] | np.uint32(1)).view(np.int32))], ["uid", "h"])
        h, u, f, c = h[~told], u[~told], f[~told], c[~told]
        order = np.argsort(h, kind="stable")
        h, u, f, c = h[order], u[order], f[order], c[order]
        new = runs_of(h)
        run = np.cumsum(new) - 1
        witnesses = np.bincount(run, (f & WITNESS) > 0)[run]
        total = np.bincount(run, c)[run]
        stay = ((f & KNOWN) > 0) | (((f & ASKS) > 0) & (witnesses > 1))
        out = h[stay] | (total[stay] > CROWD).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array(u[stay]), pa.array(out.view(np.int32))], ["uid", "h"])

    packed = own.mapInArrow(split, "bucket int, entries binary")
    met = packed.groupBy("bucket").applyInArrow(_whole(meet, {"uid": "int64", "h": "int32"}), "uid bigint, h int")
    return met.groupBy("uid").agg(F.collect_set("h").alias("hs"))


def _spot(h: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (above bit 32) and place within it of mixed hashes; both rise with the hash."""
    return (h >> np.uint64(32)) * np.uint64(buckets)


def _short(h: np.ndarray, buckets: int) -> np.ndarray:
    """31 bits of a mixed hash, enough to tell the anchors of one document apart, and a free last bit."""
    return (_spot(h, buckets) & np.uint64(0xFFFFFFFE)).astype(np.uint32)


def _steps(x: np.ndarray) -> np.ndarray:
    """What each value has more than the one before, first bytes together: rising values pack well."""
    return np.ascontiguousarray(np.diff(x, prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T)


def _from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(x.reshape(4, -1).T).view(np.uint32).ravel(), dtype=np.uint32)


def _whole(fn: Callable, columns: dict[str, str]) -> Callable:
    """A function on batches, that yields such columns, as one on a group's table."""
    import pyarrow as pa

    def run(table):
        return pa.Table.from_batches(fn(iter(table.to_batches())), pa.schema([(name, pa.type_for_alias(kind)) for name, kind in columns.items()]))
    return run


def _sieve_parts(data: bytes) -> list[np.ndarray]:
    steps, local, flag, count, used = _unpack(data, np.uint8, np.uint8, np.uint8, np.uint16, np.int64)
    short = _from_steps(steps)
    wide = len(local) // max(1, len(short))
    return [short, local.view(np.uint32 if wide == 4 else np.uint16), flag, count, used]


class Entries:
    """Contexts that came to a bucket: key (of the prefix), ids, uids, anchor places, symbols left and right of
    the anchor's place, packed bytes."""

    KINDS = (np.uint32, np.int64, np.int64, np.int32, np.uint8, np.uint8, np.int32, np.uint8)

    def __init__(self, parts: list[list[np.ndarray]]):
        key, doc, uid, many, left, right, sizes, data, place = ([p[i] for p in parts] for i in range(9))
        self.key, self.doc, self.uid, self.many, self.left, self.right = (np.concatenate(x) for x in (key, doc, uid, many, left, right))
        self.offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        self.data, self.place = np.concatenate(data), np.concatenate(place)

    def only(self, i: np.ndarray) -> Entries:
        first, sizes = np.cumsum(self.many) - self.many, np.diff(self.offsets)
        return Entries([[self.key[i], self.doc[i], self.uid[i], self.many[i], self.left[i], self.right[i], sizes[i],
                         gather(self.data, self.offsets[:-1][i], sizes[i]), self.place[_runs(first[i], self.many[i])]]])

    def by_key(self, size: int) -> Iterator[Entries]:
        """The entries in pieces of about ``size``, entries of a key together."""
        order = np.argsort(self.key, kind="stable")
        edges = np.append(np.flatnonzero(runs_of(self.key[order])), len(order))
        at = 0
        while at < len(order):
            end = max(int(edges[np.searchsorted(edges, at + size, side="right") - 1]), int(edges[np.searchsorted(edges, at, side="right")]))
            yield self.only(order[at:end])
            at = end


def contexts(own: DataFrame, kept: DataFrame, symbols: Callable, n: int, buckets: int) -> DataFrame:
    """bucket, entries, windows: packed contexts of the anchors in ``kept``, windows of the crowded ones; spans that need nothing else."""
    import pyarrow as pa

    def send(batches: Iterator) -> Iterator:
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            ids, uids = batch.column("doc_id").fill_null(0).to_numpy().astype(np.int64), batch.column("uid").to_numpy()
            hs = batch.column("hs")
            h_at = hs.offsets.to_numpy()
            h_all = hs.values.to_numpy().view(np.uint32)
            for some in _groups(slabs(offsets, SLAB)):
                yield from _bucketed([around(buf, offsets, ids, uids, h_at, h_all, a, b) for a, b in some], buckets, n)

    def around(buf, offsets, ids, uids, h_at, h_all, a, b) -> tuple[list[np.ndarray], list[np.ndarray]]:
        s = symbols(buf, offsets[a:b + 1])
        at = anchors(s.grams, s.starts, n, s.K)
        doc = np.searchsorted(s.starts, at, side="right") - 1
        h = mix64(s.grams[at]) & ~np.uint64(1)
        # Which of a document's anchors are kept, and which of those are crowded.
        wanted = np.sort(np.concatenate([_tag(h_all[h_at[i]:h_at[i + 1]], i - a) for i in range(a, b)]))
        plain = _tag(_short(h, buckets), doc)
        found = np.isin(plain, wanted) if len(wanted) else np.zeros(len(at), bool)
        crowd = np.isin(plain | np.uint64(1), wanted) if len(wanted) else found
        begin = windows(s, at[crowd], n)
        of = np.searchsorted(s.starts, begin, side="right") - 1
        many = [*s.prints(begin, begin + n), ids[a + of], uids[a + of], begin - s.starts[of]]
        # An anchor that both flags fit (31 bits tell it from another bucket's no better) goes out in both ways.
        at, doc, h = at[found], doc[found], h[found]
        left = np.minimum(at - s.starts[doc], n - s.K)
        right = np.minimum(s.starts[doc + 1] - at, n)
        data, cuts, *prints = s.cut(at - left, at + right)
        return [h, ids[a + doc], uids[a + doc], at - s.starts[doc], left, right, np.diff(cuts), *prints, data], many

    joined = own.join(kept, "uid").select("doc_id", "uid", "text", "hs", "rest", "late_uid", "late_id")
    return joined.mapInArrow(send, "bucket int, entries binary, windows binary, spans binary")


def _tag(h: np.ndarray, doc) -> np.ndarray:
    """Short hash and document in one number; the last bit stays."""
    return np.asarray(doc, np.uint64) << np.uint64(32) | h.astype(np.uint64)


def gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start:start+size] of each, one after the other."""
    total = int(size.sum())
    if not total:
        return np.zeros(0, data.dtype)
    first = np.cumsum(size) - size
    return data[np.repeat(start - first, size) + np.arange(total)]


def _groups(items: Iterator) -> Iterator[list]:
    return iter(lambda: list(itertools.islice(items, TOGETHER)), [])


def _bucketed(parts: list[tuple[list[np.ndarray], list[np.ndarray]]], buckets: int, n: int) -> Iterator:
    """Equal contexts and windows once, for the smallest id among ``parts``; the rest is settled; packed rows by bucket."""
    import pyarrow as pa

    key, doc, uid, place, left, right, size, *prints, data = (np.concatenate(x) for x in zip(*(p for p, _ in parts)))
    cuts = np.concatenate([[0], np.cumsum(size)])
    order, group, later = copies(doc, uid, place, key, left, right, *prints)
    gone = order[later]
    spans = [whole(doc[gone], uid[gone], place[gone], left[gone], right[gone])]
    own, heads, many = _stay(order, group, later, uid)
    entry = own[heads]
    mixed = mix64(key[entry])
    # Within a bucket 32 bits of the key are enough: what is taken for one prefix is compared in full anyway.
    key = np.zeros(len(key), np.uint32)
    key[entry] = mixed >> np.uint64(32)
    rows: dict[int, list[bytes]] = {}
    for k, e in _dealt(mixed & np.uint64(0xFFFFFFFF), buckets):
        i = entry[e]
        places = place[own][_runs(heads[e], many[e])]
        rows[k] = [_pack(key[i], doc[i], uid[i], many[e], left[i].astype(np.uint8), right[i].astype(np.uint8),
                         size[i].astype(np.int32), gather(data, cuts[:-1][i], size[i]), places.astype(np.int64)), b"", b""]
    one, two, doc, uid, place = (np.concatenate(x) for x in zip(*(w for _, w in parts)))
    order, group, later = copies(doc, uid, place, one, two)
    gone = order[later]
    spans.append(_merged(doc[gone], uid[gone], place[gone], place[gone] + n))
    own, heads, many = _stay(order, group, later, uid)
    entry = own[heads]
    for k, e in _dealt(one[entry], buckets):
        i = entry[e]
        places = place[own][_runs(heads[e], many[e])]
        rows.setdefault(k, [b"", b"", b""])[1] = _pack(one[i], two[i], doc[i], uid[i], many[e], places.astype(np.int64))
    spans = _merged(*(np.concatenate(x) for x in zip(*spans)))
    if len(spans[0]):
        k = int(mix64(spans[1][:1].view(np.uint64))[0] % np.uint64(buckets))
        rows.setdefault(k, [b"", b"", b""])[2] = _pack(*spans)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*rows.values()))],
                                         ["bucket", "entries", "windows", "spans"])


def _dealt(h: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that hashes fall into, with the indices of the hashes."""
    bucket = h % np.uint64(buckets)
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(buckets + 1, dtype=np.uint64))
    for k in np.flatnonzero(np.diff(edges)):
        yield int(k), by[edges[k]:edges[k + 1]]


def copies(doc, uid, place, *parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of entries by their parts, their group of equal ones in it, and which of them a smaller document has exactly so.

    Equal contexts have equal keys, sides and bytes, equal windows have equal bytes; a 128-bit fingerprint stands for the bytes.
    """
    order = np.lexsort((place, uid, doc, *parts[::-1]))
    same = np.ones(len(order), bool)
    same[0:1] = False
    for x in parts:
        same[1:] &= x[order][1:] == x[order][:-1]
    group = np.cumsum(~same) - 1
    d = doc[order]
    return order, group, d > d[np.flatnonzero(~same)][group] if len(order) else np.zeros(0, bool)


def _stay(order, group, later, uid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in the order of ``copies``: those that stay, the first of each group and uid among them, how many these have."""
    stay = np.flatnonzero(~later)
    own = order[stay]
    head = np.ones(len(stay), bool)
    head[1:] = (group[stay][1:] != group[stay][:-1]) | (uid[own][1:] != uid[own][:-1])
    heads = np.flatnonzero(head)
    return own, heads, np.diff(np.append(heads, len(stay))).astype(np.int32)


def whole(doc, uid, place, left, right):
    """Spans of all windows around anchors at ``place``: all that is sent with them."""
    return _merged(doc, uid, place - left.astype(np.int64), place + right.astype(np.int64))


def _runs(start: np.ndarray, many: np.ndarray) -> np.ndarray:
    first = np.cumsum(many) - many
    return np.repeat(start - first, many) + np.arange(int(many.sum()))


def _portions(sizes: np.ndarray, most: int = 1 << 18) -> Iterator[slice]:
    """Consecutive parts whose sizes add up to about ``most``: a periodic text has its context at very many places."""
    edges = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(edges, (edges[a - 1] if a else 0) + most, side="right")))
        yield slice(a, b)
        a = b


def _merged(doc, uid, start, end):
    """Union of spans by document."""
    if not len(doc):
        return [np.zeros(0, np.int64)] * 4
    order = np.lexsort((end, start, uid, doc))
    doc, uid, start, end = doc[order], uid[order], start[order].astype(np.int64), end[order].astype(np.int64)
    other = np.ones(len(doc), bool)
    other[1:] = (uid[1:] != uid[:-1]) | (doc[1:] != doc[:-1])
    # Ends so far within a document: documents are lifted above each other, so that one running maximum does.
    lift = (np.cumsum(other) - 1) * (int(end.max()) + 1)
    so_far = np.maximum.accumulate(end + lift)
    new = other.copy()
    new[1:] |= (start + lift)[1:] > so_far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return [doc[first], uid[first], start[first], so_far[last] - lift[last]]


def same_windows(parts: list[list[np.ndarray]], n: int) -> Iterator:
    """Spans of the windows, packed by ``_bucketed``, that a smaller document has too."""
    one, two, doc, uid, many, place = (np.concatenate(x) for x in zip(*parts))
    order, _, later = copies(doc, uid, many, one, two)
    first, i = np.cumsum(many) - many, order[later]
    for some in _portions(many[i]):
        k = i[some]
        again, at = np.repeat(k, many[k]), place[_runs(first[k], many[k])]
        yield _merged(doc[again], uid[again], at, at + n)


def settled(sent: DataFrame, settle: Callable, n: int) -> DataFrame:
    """doc_id, uid, start, end: spans of windows that start in a document with a smaller id.

    ``settle(entries)`` gives, for windows that begin j symbols before an anchor, the pairs (entry, j) to remove.
    """
    import pyarrow as pa

    def group(batches: Iterator) -> Iterator:
        parts, many, spans = [], [], []
        for batch in batches:
            for e, w, s in zip(batch.column("entries"), batch.column("windows"), batch.column("spans")):
                if len(e.as_py()):
                    parts.append(_unpack(e.as_py(), *Entries.KINDS, np.int64))
                if len(w.as_py()):
                    many.append(_unpack(w.as_py(), np.uint64, np.uint64, np.int64, np.int64, np.int32, np.int64))
                if len(s.as_py()):
                    spans.append(_unpack(s.as_py(), np.int64, np.int64, np.int64, np.int64))
        if many:
            spans += same_windows(many, n)
        for e in Entries(parts).by_key(SETTLED) if parts else ():
            first = np.cumsum(e.many) - e.many
            # Contexts that a smaller document has exactly so lose all their windows.
            prints = [slice_hashes(e.data, e.offsets[:-1], e.offsets[1:], k) for k in (0, 1)]
            order, group, later = copies(e.doc, e.uid, e.many, e.key, e.left, e.right, *prints)
            i = order[later]
            for some in _portions(e.many[i]):
                k = i[some]
                again = np.repeat(k, e.many[k])
                spans.append(whole(e.doc[again], e.uid[again], e.place[_runs(first[k], e.many[k])], e.left[again], e.right[again]))
            # The others are compared within their prefix, if it has several contexts.
            key = e.key[order]
            new = runs_of(key)
            run = np.cumsum(new) - 1
            kinds = np.bincount(run, np.append(True, group[1:] != group[:-1]))[run]
            e = e.only(np.sort(order[~later & (kinds > 1)]))
            if not len(e.key):
                continue
            row, j = settle(e)
            if not len(row):
                continue
            # Windows side by side are one span at each place of their entry.
            order = np.lexsort((j, row))
            row, j = row[order], j[order]
            new = runs_of(row)
            new[1:] |= j[1:] != j[:-1] + 1
            begin = np.flatnonzero(new)
            row, low, high = row[begin], j[begin], j[np.append(begin[1:], len(j)) - 1]
            first = np.cumsum(e.many) - e.many
            for some in _portions(e.many[row]):
                k = row[some]
                place = e.place[_runs(first[k], e.many[k])]
                again = np.repeat(np.arange(some.start, some.stop), e.many[k])
                spans.append(_merged(e.doc[row[again]], e.uid[row[again]], place - high[again], place - low[again] + n))
        if spans:
            out = [np.concatenate(x) for x in zip(*spans)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["doc_id", "uid", "start", "end"])

    return sent.groupBy("bucket").applyInArrow(_whole(group, dict.fromkeys(["doc_id", "uid", "start", "end"], "int64")), "doc_id bigint, uid bigint, start bigint, end bigint")


def later_texts(docs: DataFrame) -> DataFrame:
    """late_uid, late_id: the rows whose whole text a row with a smaller doc_id has; stored."""
    ids = docs.filter(F.col("doc_id").isNotNull()).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("uid"), *(F.xxhash64(F.lit(k), F.coalesce("text", F.lit(""))).alias(f"text{k}") for k in (1, 2)))
    first = ids.groupBy("text1", "text2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("last > first")
    late = ids.join(first, ["text1", "text2"]).filter("doc_id > first").select(F.col("uid").alias("late_uid"), F.col("doc_id").alias("late_id")).distinct()
    return stored(docs.sparkSession, late, "later-texts")


def repeated_spans(docs: DataFrame, symbols: Callable, settle: Callable, n: int, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, rest (a struct of the columns in ``keep``), spans, late: every row with the spans (doc_id, start, end, in symbols,
    sorted) to remove from it; of a late one all its windows go."""
    own = identified(docs, keep or [])
    late = later_texts(docs)
    buckets = 2 * partitions(docs.sparkSession)
    # All three passes use this one exchange of the texts: what only some of them need (columns, filters, anti joins) would be
    # pushed below it and make it anew, so rows are told apart within the passes.
    is_late = (F.col("uid") == F.col("late_uid")) & F.col("doc_id").between(F.col("late_id"), F.col("late_id"))
    dealt = own.repartition("uid").join(late, is_late, "left")
    kept = sieve(dealt, symbols, n, buckets)
    spans = settled(contexts(dealt, kept, symbols, n, buckets), settle, n)
    spans = spans.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("doc_id", "start", "end"))).alias("spans"))
    out = dealt.join(spans, "uid", "left")
    return out.select("doc_id", "text", "rest", "spans", F.col("late_uid").isNotNull().alias("late"))


def of_document(doc_id, spans, late: bool, size: int, n: int) -> list[tuple[int, int]]:
    """The union of the sorted spans of a document of ``size`` symbols; a span of another document with the same uid isn't its own."""
    if late:
        return [(0, size)] if size >= n else []
    out: list[list[int]] = []
    for s in spans or []:
        if s["doc_id"] != doc_id:
            continue
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["end"])
        else:
            out.append([s["start"], s["end"]])
    return [(a, b) for a, b in out]
