"""Substring dedup by prefix-partitioned suffix trees over words.

Suffixes begin at the anchors of ``repeats`` and are partitioned by prefix, the anchor's words; where too many share
it, ``repeats`` compares their windows by fingerprints instead. Each partition is small and becomes one subtree: its suffixes in order,
with the depths to which neighbours agree, are the tree's leaves and internal nodes. A window of n words that
begins j words before an anchor repeats where an internal node of depth n - j holds leaves with the same j words
on their left: these are the deep nodes whose left extensions are the maximal repeats. Of the leaves that
agree, those of documents with larger ids lose the window.

Words are ``[^\\x20\\x09-\\x0D]+``, unchanged. Edge cases: null, empty and blank texts have no words; texts shorter than a
window lose none; a window repeated within one document stays there; rows that share a doc_id are judged
each by its own text and never remove from each other; rows without doc_id are returned whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from stepfield.llm import repeats
from stepfield.llm.base import mix64

WINDOW = 50
_W = WINDOW - repeats.Symbols.K + 1
_BASE = 0x9E3779B97F4A7C15


class Words(repeats.Symbols):
    def __init__(self, buf: np.ndarray, offsets: np.ndarray):
        words, counts = [], []
        whole = buf[offsets[0]:offsets[-1]].tobytes()
        for a, b in zip((offsets[:-1] - offsets[0]).tolist(), (offsets[1:] - offsets[0]).tolist()):
            own = whole[a:b].split()
            words += own
            counts.append(len(own))
        self.plain = np.frombuffer(b" ".join(words), np.uint8)
        self.ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        self.begins = np.concatenate([[0], self.ends + 1])[:-1] if words else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        gram = repeats.slice_hashes(self.plain, self.begins, self.ends)
        size = 1
        while size < self.K:
            short = gram[:max(0, len(gram) - size)] * np.uint64(_BASE) + gram[size:]
            gram = mix64(np.concatenate([short, np.zeros(len(gram) - len(short), np.uint64)]))
            size *= 2
        for back in range(1, self.K):
            over = starts[1:] - back
            gram[over[over >= starts[:-1]]] = repeats.NONE
        super().__init__(gram, starts)

    def _bytes(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (self.begins[first], self.ends[last - 1]) if len(first) else (first, last)

    def prints(self, first: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        return [repeats.slice_hashes(self.plain, *self._bytes(first, last), k) for k in (0, 1)]

    def cut(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = self._bytes(first, last)
        return repeats.gather(self.plain, a, b - a), np.concatenate([[0], np.cumsum(b - a)]), *self.prints(first, last)


def subtrees(e: repeats.Entries) -> tuple[np.ndarray, np.ndarray]:
    """(entry, j): windows that begin j words before an entry's anchor and are in a document with a smaller id."""
    space = np.flatnonzero(e.data == 32)
    begins = np.sort(np.concatenate([e.offsets[:-1], space + 1]))
    ends = np.sort(np.concatenate([space, e.offsets[1:]]))
    word = repeats.slice_hashes(e.data, begins, ends)
    left, right = e.left.astype(np.int64), e.right.astype(np.int64)
    at = np.cumsum(left + right) - right  # the word at which each suffix begins
    col = np.arange(WINDOW)
    suffix = np.where(col < right[:, None], word[np.minimum(at[:, None] + col, len(word) - 1)], np.uint64(0))
    # Leaves in order, and how many words each shares with the one before it.
    order = np.lexsort([*suffix.T[::-1], e.key])
    s, key = suffix[order], e.key[order]
    depth = np.zeros(len(order), np.int64)
    if len(order) > 1:
        differ = s[1:] != s[:-1]
        depth[1:] = np.where(differ.any(1), differ.argmax(1), WINDOW)
        depth[1:][key[1:] != key[:-1]] = 0
    doc, left, right, at = e.doc[order], left[order], right[order], at[order]
    before = np.zeros(len(order), np.uint64)
    rows, back = [], []
    for j in range(_W):
        if j:
            before = mix64(before * np.uint64(_BASE) + word[np.maximum(at - j, 0)])
        # Internal nodes of depth WINDOW - j: runs of two leaves or more.
        new = depth < WINDOW - j
        node = np.cumsum(new)
        inner = ~(new & np.append(new[1:], True))
        valid = np.flatnonzero(inner & (right >= WINDOW - j) & (left >= j))
        if not len(valid):
            continue
        mark = mix64(node[valid].astype(np.uint64) * np.uint64(_BASE)) ^ before[valid]
        by = np.argsort(mark, kind="stable")
        least = repeats.least_in_run(repeats.runs_of(mark[by]), doc[valid][by])
        gone = valid[by][doc[valid][by] > least]
        rows.append(order[gone])
        back.append(np.full(len(gone), j, np.int64))
    return (np.concatenate(rows), np.concatenate(back)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def kept_words(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, text, rest (``keep`` as a struct), kept, n_words, n_removed of every row; kept: the words left, joined by one space."""
    import pyarrow as pa

    found = repeats.repeated_spans(docs, Words, subtrees, WINDOW, keep)
    rest = found.schema["rest"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator) -> Iterator:
        for batch in batches:
            kept, all_words, gone = [], [], []
            for doc_id, text, spans, late in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "spans", "late"))):
                words = text.encode().split()
                all_words.append(len(words))
                for a, b in reversed(repeats.of_document(doc_id, spans, late, len(words), WINDOW)):
                    del words[a:b]
                gone.append(all_words[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), batch.column("rest"), pa.array(kept, pa.string()), pa.array(all_words, pa.int64()),
                                              pa.array(gone, pa.int64())], ["doc_id", "text", "rest", "kept", "n_words", "n_removed"])

    return found.mapInArrow(cut, f"doc_id {kind}, text string, rest {rest}, kept string, n_words bigint, n_removed bigint")


