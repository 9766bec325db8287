"""Byte dedup by longest-previous-factor arrays over suffixes in order.

The suffixes are those n-byte windows around the anchors of ``repeats`` that may repeat. In suffix order, with the
bytes that neighbours share, the previous and the next entry of a smaller document ("position") are found for
each suffix; the longer of the two common prefixes is its longest previous factor. Where it reaches n bytes the
window is a later copy and goes; the first copy stays.

Edge cases: a null text is empty; matches never cross documents; texts shorter than n bytes lose none; repeats
within a document stay; rows that share a doc_id are judged each by its own text and never remove from each other;
rows without doc_id are returned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from stepfield.llm import repeats
from stepfield.llm.base import mix64

WINDOW = 50
#: Bytes of an anchor.
K = 24
_LEFT = WINDOW - K
_WIDE = _LEFT + WINDOW
_BASE = 0x9E3779B97F4A7C15
#: Contexts whose windows are hashed at a time.
_ROWS = 1 << 14


class Bytes(repeats.Symbols):
    K = K

    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        self.plain = buf[offsets[0]:offsets[-1]]
        starts = offsets - offsets[0]
        n = len(self.plain)
        room = np.zeros((n // 8 + K // 8 + 1) * 8, np.uint8)
        room[:n] = self.plain
        eight = np.empty(len(room) - 8, np.uint64)  # the eight bytes from each place
        for k in range(8):
            eight[k::8] = room[k:k + len(eight)].view("<u8") if k == 0 else np.frombuffer(room[k:k + len(eight)].tobytes(), "<u8")
        gram = mix64(eight[:n])
        for k in range(8, K, 8):
            gram = mix64(gram + eight[k:k + n] * np.uint64(_BASE))
        for back in range(1, K):
            over = starts[1:] - back
            gram[over[over >= starts[:-1]]] = repeats.NONE
        super().__init__(gram, starts)

    def prints(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        return [repeats.slice_hashes(self.plain, first, last, k) for k in (0, 1)]

    def cut(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        return repeats.gather(self.plain, first, last - first), np.concatenate([[0], np.cumsum(last - first)]), *self.prints(first, last)


def longest_previous(order_lcp: np.ndarray, position: np.ndarray, enough: int) -> np.ndarray:
    """For suffixes in order, the longest prefix shared with one of a smaller position, by the previous and the
    next smaller position; values below ``enough`` may come out too small.

    order_lcp[i]: bytes shared by suffixes i - 1 and i. The links to the previous (next) entry are doubled until
    they lead to a smaller position or the shared prefix is no longer enough.
    """
    best = np.zeros(len(position), np.int64)
    for step in (-1, 1):
        pos = position if step < 0 else position[::-1]
        shared = order_lcp.copy() if step < 0 else np.append(order_lcp[1:], 0)[::-1].copy()
        to = np.arange(-1, len(pos) - 1)
        if len(shared):
            shared[0] = 0
        while True:
            open_ = np.flatnonzero((shared >= enough) & (pos[np.maximum(to, 0)] >= pos))
            if not len(open_):
                break
            # All links are taken at once; an entry that is passed over has nothing smaller than itself before its own link.
            at = to[open_]
            shared[open_] = np.minimum(shared[open_], shared[at])
            to[open_] = to[at]
            shared[open_[to[open_] < 0]] = 0
        found = np.where((to >= 0) & (shared >= enough), shared, 0)
        best = np.maximum(best, found if step < 0 else found[::-1])
    return best


def later_copies(e: repeats.Entries) -> tuple[np.ndarray, np.ndarray]:
    """(entry, j): windows that begin j bytes before an entry's anchor and are in a document with a smaller id."""
    left, right = e.left.astype(np.int64), e.right.astype(np.int64)
    n, j = len(left), np.arange(_LEFT + 1)
    size = left + right
    around = np.zeros((n, _WIDE), np.uint8)
    col = np.arange(int(size.sum())) - np.repeat(e.offsets[:-1], size) + np.repeat(_LEFT - left, size)
    around[np.repeat(np.arange(n), size), col] = e.data
    valid = (left[:, None] >= j) & (right[:, None] >= WINDOW - j)
    # Windows whose hash occurs once can't be copies and stay out of the suffix order.
    rows, back, marks = [], [], []
    value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    up = np.array([pow(_BASE, i, 1 << 64) for i in range(_WIDE)], np.uint64)
    down = np.array([pow(pow(_BASE, -1, 1 << 64), i, 1 << 64) for i in range(_WIDE)], np.uint64)
    for a in range(0, n, _ROWS):
        total = np.zeros((min(_ROWS, n - a), _WIDE + 1), np.uint64)
        np.cumsum(value[around[a:a + _ROWS]] * up, axis=1, out=total[:, 1:])
        begin = _LEFT - j
        mark = mix64((total[:, begin + WINDOW] - total[:, begin]) * down[begin])
        i, k = np.nonzero(valid[a:a + _ROWS])
        rows.append(i + a)
        back.append(k)
        marks.append(mark[i, k])
    row, back, mark = np.concatenate(rows), np.concatenate(back), np.concatenate(marks)
    order = np.argsort(mark)
    new = repeats.runs_of(mark[order])
    alone = new & np.append(new[1:], True) if len(new) else new
    keep = order[~alone]
    row, back = row[keep], back[keep]
    if not len(row):
        return row, back
    # Suffix order; equal suffixes by document.
    by = np.argsort(e.doc[row], kind="stable")
    row, back = row[by], back[by]
    suffix = np.lib.stride_tricks.sliding_window_view(around, WINDOW, axis=1)[row, _LEFT - back]
    by = np.argsort(np.ascontiguousarray(suffix).view(f"S{WINDOW}").ravel(), kind="stable")
    row, back, suffix = row[by], back[by], suffix[by]
    lcp = np.zeros(len(row), np.int64)
    differ = suffix[1:] != suffix[:-1]
    lcp[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
    gone = longest_previous(lcp, e.doc[row], WINDOW) >= WINDOW
    return row[gone], back[gone]


def kept_bytes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every row."""
    import pyarrow as pa

    found = repeats.repeated_spans(docs, Bytes, later_copies, WINDOW)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, text, spans, late in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "late"))):
                text, parts, at = text.encode(), [], 0
                gone = repeats.of_document(doc_id, spans, late, len(text), WINDOW)
                for a, b in gone:
                    parts.append(text[at:a])
                    at = b
                kept = b"".join([*parts, text[at:]])
                for column, v in zip(out, (len(text), len(text) - len(kept), len(gone), kept)):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id")] + [pa.array(c, pa.int64()) for c in out[:3]] + [pa.array(out[3], pa.binary())],
                                             ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return found.mapInArrow(cut, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
