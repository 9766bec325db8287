"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of ``WIDTH`` bytes slide by ``STRIDE`` over overlapping chunks that cover the
whole text; each filter's maximum over a chunk goes through a small dense layer to the chunk's logit; the mean
of a document's logits is its logit. Learning (Adam, backwards through the maxima) takes a bounded sample: at
most ``PER_LABEL`` rows of each label, chosen by a hash of the id; of each, ``CHUNKS`` evenly spread chunks and a
few words by themselves.
In scoring every byte of every text is read: two bytes at a time look up their part of all filters at once.

Edge cases: null and empty texts are one chunk of zero bytes and get a score like any other; without labels of
both kinds every score is the share of label 1 (0.5 without labels). A doc_id with several labels is learned
with each; rows that share an id are scored each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import byte_view, held_out, sampled, slabs

#: Bounds of the sample that is learned from: rows of a label, chunks of a row.
PER_LABEL, CHUNKS = 1500, 8
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 16, 16
#: Bytes of a chunk, and from one chunk to the next.
CHUNK, STEP = 256, 224
STEPS, BATCH, RATE, SLAB, ROWS = 600, 96, 4e-3, 1 << 18, 2048
#: Weight in learning of a few words against that of their text.
SNIPPET = 0.3
_PLACES, _HOP, _PAIRS = (CHUNK - WIDTH) // STRIDE + 1, STEP // STRIDE, WIDTH // 2


def chunk_count(n: np.ndarray) -> np.ndarray:
    """Chunks of texts with n filter places."""
    return 1 + np.maximum(0, -(-(n - _PLACES) // _HOP))


def padded_size(n: np.ndarray) -> np.ndarray:
    """Bytes of a text with zeros up to a whole number of strides and one filter at least."""
    return np.maximum(WIDTH, n + n % STRIDE)


class Model:
    def __init__(self, share: float):
        rng = np.random.default_rng(11)
        self.share = share
        self.trained = False
        self.p = {"e": rng.normal(0, 0.3, (256, EMBED)), "k": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), "c": np.zeros(FILTERS),
                  "h": rng.normal(0, 0.3, (FILTERS + 1, HIDDEN)), "d": np.zeros(HIDDEN), "o": rng.normal(0, 0.3, HIDDEN), "z": np.zeros(1)}
        self.p = {name: v.astype(np.float32) for name, v in self.p.items()}

    def dense(self, top: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logits of chunks from their filters' maxima and how full they are."""
        act = np.concatenate([np.tanh(top), places[:, None] / np.float32(_PLACES)], 1)
        return np.maximum(act @ self.p["h"] + self.p["d"], 0) @ self.p["o"] + self.p["z"]

    def _gradients(self, chunks: np.ndarray, doc: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """chunks: bytes (m, CHUNK) and a last byte, their filter places; doc: the text of each; y, weight: of each text."""
        p, m = self.p, len(chunks)
        full = chunks[:, CHUNK:] / np.float32(_PLACES)
        at = np.arange(_PLACES)[:, None] * STRIDE + np.arange(WIDTH)
        own = chunks[:, at]
        conv = p["e"][own].reshape(m, _PLACES, -1) @ p["k"] + p["c"]
        place = conv.argmax(1)
        top = np.take_along_axis(conv, place[:, None], 1)[:, 0]
        act = np.concatenate([np.tanh(top), full], 1)
        hidden = act @ p["h"] + p["d"]
        on = np.maximum(hidden, 0)
        many = np.bincount(doc, minlength=len(y)).astype(np.float32)
        logit = np.bincount(doc, on @ p["o"] + p["z"], minlength=len(y)) / np.maximum(many, 1)
        pull = weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / weight.sum()
        g = (pull / np.maximum(many, 1))[doc].astype(np.float32)[:, None]
        out = {"o": (on * g).sum(0), "z": g.sum(0)}
        gh = g * p["o"] * (hidden > 0)
        out |= {"h": act.T @ gh, "d": gh.sum(0)}
        gt = ((gh @ p["h"].T) * (1 - act * act))[:, :FILTERS]
        out["c"] = gt.sum(0)
        bytes_at = own[np.arange(m)[:, None], place]  # (m, FILTERS, WIDTH): what each maximum saw
        seen = p["e"][bytes_at].reshape(m, FILTERS, -1)
        out["k"] = np.einsum("mfi,mf->if", seen, gt)
        back = (gt[:, :, None] * p["k"].T).reshape(-1, EMBED)
        out["e"] = np.stack([np.bincount(bytes_at.ravel(), back[:, i], minlength=256) for i in range(EMBED)], 1)
        return out

    def fit(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        """texts: the chunks (n, CHUNK + 1) of each."""
        rng = np.random.default_rng(5)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for t in range(1, STEPS + 1):
            part = rng.choice(len(texts), min(BATCH, len(texts)), replace=False)
            doc = np.repeat(np.arange(len(part)), [len(texts[i]) for i in part])
            g = self._gradients(np.concatenate([texts[i] for i in part]), doc, y[part], weight[part])
            rate = RATE * (1 - (t - 1) / STEPS)
            for k, v in self.p.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.99 * second[k] + 0.01 * g[k] ** 2
                v -= (rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.99 ** t)) + 1e-7)).astype(np.float32)
        self.trained = True

    def tables(self) -> list[np.ndarray]:
        """For each pair of bytes in a filter, what each pair of values adds to all filters."""
        e, k = self.p["e"], self.p["k"].reshape(WIDTH, EMBED, FILTERS)
        return [((e @ k[2 * t])[:, None, :] + (e @ k[2 * t + 1])[None, :, :] + self.p["c"] / _PAIRS).reshape(65536, FILTERS) for t in range(_PAIRS)]

    def scores(self, buf: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Scores of the whole texts between ``offsets``."""
        sizes = np.diff(offsets)
        if not self.trained:
            return np.full(len(sizes), self.share)
        room = padded_size(sizes)
        at = np.concatenate([[0], np.cumsum(room)])
        own = np.zeros(at[-1] + WIDTH, np.uint8)
        for i, n in enumerate(sizes):
            own[at[i]:at[i] + n] = buf[offsets[i]:offsets[i] + n]
        pair = own[0::2].astype(np.int32) << 8 | own[1::2]
        places = len(pair) - _PAIRS + 1
        conv = tables[0][pair[:places]]
        for t in range(1, _PAIRS):
            conv += tables[t][pair[t:t + places]]
        n = (room - WIDTH) // STRIDE + 1
        many = chunk_count(n)
        doc = np.repeat(np.arange(len(sizes)), many)
        low = (np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)) * _HOP
        start = at[doc] // STRIDE + low
        end = at[doc] // STRIDE + np.minimum(low + _PLACES, n[doc])
        top = np.maximum.reduceat(conv, np.stack([start, end], 1).ravel())[::2]
        logit = np.bincount(doc, self.dense(top, end - start), minlength=len(sizes)) / many
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _chunks(text: np.ndarray) -> np.ndarray:
    """At most CHUNKS evenly spread chunks (n, CHUNK + 1) of a text; the last byte has the number of filter places."""
    places = (padded_size(np.int64(len(text))) - WIDTH) // STRIDE + 1
    many = int(chunk_count(places))
    picked = np.unique(np.linspace(0, many - 1, min(many, CHUNKS)).astype(int))
    out = np.zeros((len(picked), CHUNK + 1), np.uint8)
    for i, c in enumerate(picked):  # a short chunk is repeated, so that it has no other bytes
        part = text[c * STEP:c * STEP + CHUNK]
        out[i, CHUNK] = min(_PLACES, places - c * _HOP)
        out[i, :CHUNK] = np.resize(np.pad(part, (0, max(0, WIDTH - len(part)))), CHUNK)
    return out


def _snippet(text: np.ndarray) -> np.ndarray:
    """A few words from within a text; texts this short are rare in a sample, and few words say little about quality."""
    n = len(text)
    spaces = np.flatnonzero(text[n // 3:n // 3 + 400] == 32)
    start = n // 3 + (int(spaces[0]) + 1 if len(spaces) else 0)
    size = 5 + n * 7919 % 70
    after = np.flatnonzero(text[start + size:start + size + 40] == 32)
    return text[start:start + size + (int(after[0]) if len(after) else 0)]


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from rows (doc_id, text) with a label (doc_id, quality) that are not held out."""
    marks = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "quality").distinct()
    shares = {r[0]: r[1] for r in marks.groupBy("quality").count().collect()}
    model = Model(shares.get(1, 0) / sum(shares.values()) if shares else 0.5)
    if len(shares) < 2:
        return model
    keys = sampled(marks, "quality", shares, PER_LABEL)
    # At most 2 * PER_LABEL ids: sent to the texts, which stay where they are.
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(keys), "doc_id")

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            texts = [buf[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
            for part, snippet in ((texts, False), ([_snippet(t) for t in texts], True)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("quality"), pa.array([_chunks(t).tobytes() for t in part], pa.binary()), pa.array([snippet] * len(part), pa.bool_())],
                    ["quality", "chunks", "snippet"])

    kind = labels.schema["quality"].dataType.simpleString()
    # The order is one of content, so the model depends neither on the files nor on the tasks; of rows beyond the bound (many that share
    # an id), those of the least hashes stay.
    cuts = sample.mapInArrow(cut, f"quality {kind}, chunks binary, snippet boolean")
    rows = cuts.orderBy(F.xxhash64("chunks", "quality", "snippet"), "chunks", "quality", "snippet").limit(8 * PER_LABEL).collect()
    y = np.array([float(r.quality) for r in rows], np.float32)
    if len(set(y)) < 2:
        return model
    # Each label weighs as much as it has rows among all labels, whatever its part of the sample.
    weight = np.where(y == 1, model.share / max(1, (y == 1).sum()), (1 - model.share) / max(1, (y == 0).sum())) * len(y)
    weight *= np.where([r.snippet for r in rows], SNIPPET, 1.0)
    model.fit([np.frombuffer(r.chunks, np.uint8).reshape(-1, CHUNK + 1) for r in rows], y, weight.astype(np.float32))
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id, if not given), held_out, score, predicted of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        m = shared.value
        tables = m.tables()
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            parts = [m.scores(buf, offsets[a:b + 1], tables) for a, b in slabs(offsets, SLAB, ROWS)]
            out = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("rest"), batch.column("held"), pa.array(out), pa.array((out >= 0.5).astype(np.int32))],
                                             ["rest", "held_out", "score", "predicted"])

    keep = keep or ["doc_id"]
    own = docs.select(F.struct(*keep).alias("rest"), held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"))
    kind = own.schema["rest"].dataType.simpleString()
    out = own.mapInArrow(run, f"rest {kind}, held_out boolean, score double, predicted int")
    return out.select("rest.*", "held_out", "score", "predicted")
