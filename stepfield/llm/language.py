"""Language identification by error-correcting output codes.

Each language gets a codeword; one binary classifier over hashed byte n-grams predicts each bit. Decoding sums,
for each codeword, the logistic losses of its bits at the classifiers' margins, each weighted by how well its
classifier did in learning; the codeword with the least loss is the answer, and the share it has of all
codewords' likelihoods is the score. ``ambiguous`` marks answers whose runner-up is nearly as near.

Every language is learned, from a bounded sample: ``TOTAL`` rows shared by the languages (one each at least), at most
``PER_LANGUAGE`` rows each, chosen by a hash of the id. Every text is read whole, in learning and in prediction.

Edge cases: null, empty or letterless texts are ``und`` with score 0; with no labelled row all texts are, and
with one language all others get it. Rows that share an id are judged each by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfield.llm.base import byte_view, held_out, sampled, slabs

#: Bounds of the sample that is learned from.
PER_LANGUAGE, TOTAL = 400, 25_600
#: Feature cells, longest n-gram, bytes and rows that are counted at a time.
CELLS, LONGEST, SLAB, ROWS = 4096, 3, 1 << 20, 256
ROUNDS, RATE, DECAY = 150, 4.0, 1e-5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def features(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of hashed n-gram counts (square roots, length 1) of the texts between ``offsets``."""
    n, base = len(offsets) - 1, offsets[0]
    own = _LOWER[buf[base:offsets[-1]]].astype(np.uint32)
    ends = offsets[1:] - base
    counts = np.zeros(n * CELLS + 1, np.int64)
    row = np.repeat(np.arange(n, dtype=np.int64) * CELLS, np.diff(offsets))
    code = np.zeros(len(own), np.uint32)
    for size in range(1, LONGEST + 1):
        if len(own) < size:
            break
        code = (code[:len(own) - size + 1] << np.uint32(8)) | own[size - 1:]
        cell = ((code * np.uint32(2654435761) + np.uint32(size * 40503)) >> np.uint32(20)).astype(np.int64) + row[:len(code)]
        for back in range(1, size):  # grams that reach into the next text
            over = ends - back
            cell[over[(over >= 0) & (over < len(cell))]] = n * CELLS
        counts += np.bincount(cell, minlength=n * CELLS + 1)
    x = np.sqrt(counts[:-1].reshape(n, CELLS).astype(np.float32))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def codewords(k: int) -> np.ndarray:
    """k rows of bits -1/+1: all splits of few languages, else random splits (fixed seed) with far-apart rows."""
    if k <= 6:
        bits = [[1] + [1 if (b >> i) & 1 else -1 for i in range(k - 1)] for b in range((1 << (k - 1)) - 1)]
        return np.array(bits, np.float32).reshape(-1, k).T
    rng, best, far = np.random.default_rng(7), None, -1
    n = 15 + int(10 * np.log2(k))
    for _ in range(max(1, min(200, 10**8 // k**2))):  # very many languages have few tries, and long codewords
        code = rng.choice(np.array([-1, 1], np.float32), (k, n))
        code = code[:, np.abs(code.sum(0)) < k]
        apart = min(int((code.shape[1] - code[i] @ code[:i].T).min()) // 2 for i in range(1, k))
        if apart > far:
            best, far = code, apart
    return best


class Model:
    """Languages, their codewords, and a linear classifier for each bit."""

    def __init__(self, languages: list[str], x: np.ndarray, y: np.ndarray):
        self.languages = languages
        self.code = codewords(len(languages)) if languages else np.zeros((0, 0), np.float32)
        self.w = np.zeros((CELLS, self.code.shape[1]), np.float32)
        self.b = np.zeros(self.code.shape[1], np.float32)
        self.weight = np.ones(self.code.shape[1], np.float32)
        if len(languages) > 1:
            self._fit(x, self.code[y], np.bincount(y, minlength=len(languages))[y])

    def _fit(self, x: np.ndarray, bits: np.ndarray, share: np.ndarray) -> None:
        """Logistic regressions by gradient steps with momentum; each language weighs the same."""
        weight = (1.0 / share / len(self.languages)).astype(np.float32)[:, None]
        step_w, step_b = np.zeros_like(self.w), np.zeros_like(self.b)
        for _ in range(ROUNDS):
            pull = weight * bits / (1 + np.exp(np.clip(bits * (x @ self.w + self.b), -30, 30)))
            step_w = 0.9 * step_w + RATE * (x.T @ pull - DECAY * self.w)
            step_b = 0.9 * step_b + 0.1 * RATE * pull.sum(0)
            self.w += step_w
            self.b += step_b
        right = (weight * ((x @ self.w + self.b) * bits > 0)).sum(0)
        self.weight = np.maximum(right - 0.5, 0.01) / np.maximum(right - 0.5, 0.01).mean()

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, its share, whether the second is nearly as near."""
        margin = x @ self.w + self.b
        loss = np.logaddexp(0, -margin) @ (self.weight * (self.code > 0)).T + np.logaddexp(0, margin) @ (self.weight * (self.code < 0)).T
        loss = loss.astype(np.float64)
        like = np.exp(loss.min(1, keepdims=True) - loss)
        like /= like.sum(1, keepdims=True)
        top = np.sort(like, 1)
        gap = top[:, -1] - top[:, -2] if like.shape[1] > 1 else np.ones(len(x))
        return loss.argmin(1), like.max(1), gap < 0.2


def learn(docs: DataFrame) -> Model:
    """A model from rows (doc_id, text, lang) that are not held out."""
    own = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r[0]: r[1] for r in own.groupBy("lang").count().collect()}
    if not counts:
        return Model([], np.zeros((0, CELLS), np.float32), np.zeros(0, np.int64))
    most = max(1, min(PER_LANGUAGE, TOTAL // len(counts)))
    keys = sampled(own, "lang", counts, most)
    # At most ``most`` ids of each language: sent to the texts, which stay where they are.
    sample = own.join(F.broadcast(keys), ["doc_id", "lang"], "left_semi")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            for a, b in slabs(offsets, SLAB, ROWS):
                x = features(buf, offsets[a:b + 1]).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(a, b - a), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "x"])

    # What comes to the driver has a fixed size for each row, and rows that repeat an id can't make it more.
    # Their order is one of content, so the model depends neither on the files nor on the tasks.
    rows = sample.mapInArrow(count, "lang string, x binary").orderBy(F.xxhash64("x", "lang"), "x", "lang").limit(2 * most * len(counts)).collect()
    languages = sorted(counts)
    x = np.array([np.frombuffer(r.x, np.float16) for r in rows], np.float32).reshape(-1, CELLS)
    place = {lang: i for i, lang in enumerate(languages)}
    y = np.array([place[r.lang] for r in rows], np.int64)
    return Model(languages, x, y)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of every row; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        m = shared.value
        for batch in batches:
            buf, offsets = byte_view(batch.column("text"))
            letters = batch.column("letters").to_numpy(zero_copy_only=False)
            name, score, unsure = np.full(len(letters), "und", object), np.zeros(len(letters)), np.zeros(len(letters), bool)
            for a, b in slabs(offsets, SLAB, ROWS) if m.languages else ():
                best, share, near = m.decode(features(buf, offsets[a:b + 1]))
                own = letters[a:b]
                name[a:b] = np.where(own, np.array(m.languages, object)[best], "und")
                score[a:b], unsure[a:b] = np.where(own, share, 0.0), near & own
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held"), pa.array(name, pa.string()), pa.array(score), pa.array(unsure)],
                ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    own = docs.select("doc_id", held_out().alias("held"), F.coalesce("text", F.lit("")).alias("text"),
                      F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return own.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")
