"""The near-dedup stage: recall on planted pairs, groups by brute force, hot groups, awkward rows."""

import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import data  # noqa: E402

from stepfield.llm import similar  # noqa: E402

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text, n=5):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)}


def alike(a, b):
    return len(a & b) / len(a | b)


def plain_groups(texts, least=0.8):
    """Label of each text, by all pairs."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and alike(sets[i], sets[j]) >= least:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], KIND).repartition(parts)


def say(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def changed(rng, words, k):
    out = list(words)
    for i in rng.sample(range(len(words)), k):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


def test_recall_from_similarity_0_8(spark):
    rng, rows, pairs = random.Random(12), [], []
    for size, k in ((100, 2), (300, 5), (400, 8), (1000, 10), (1000, 2)):
        for _ in range(50):
            a = say(rng, size)
            b = changed(rng, a, k)
            if alike(shingle_set(" ".join(a)), shingle_set(" ".join(b))) < 0.8:
                continue
            pairs.append(len(rows))
            rows += [(len(rows), " ".join(a)), (len(rows) + 1, " ".join(b))]
    far = [(10_000 + i, " ".join(say(rng, 100))) for i in range(100)]
    for i in range(50):  # similarity below 0.8: both stay
        far.append((20_000 + i, " ".join(changed(rng, far[i][1].split(), 8))))
    stay = {r.doc_id for r in similar.one_of_each(frame(spark, rows + far)).collect()}
    assert {i for i, _ in far} <= stay and {i for i in pairs} <= stay
    caught = sum(i + 1 not in stay for i in pairs) / len(pairs)
    assert len(pairs) > 200 and caught >= 0.97


@pytest.mark.parametrize("hot", [False, True])
def test_groups_by_brute_force(spark, hot):
    rng, rows = random.Random(3), []
    for g in range(12):
        base = say(rng, 60)
        for _ in range(60 if hot and g == 0 else 4):
            rows.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 1, 6]))))
    rows += [rows[3].upper(), "  " + rows[5].replace(" ", "\n"), "", None, " \t", "one two", "One  two", "one two three"]
    want = plain_groups(rows)
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    got = {r.doc_id: r.label for r in similar.groups(frame(spark, list(zip(ids, rows)))).collect()}
    by = {}
    for i, w in zip(ids, want):
        by.setdefault(w, set()).add(got[i])
    # Nothing that is apart is joined, and few links are missed.
    assert len(set(got.values())) == sum(map(len, by.values()))
    assert sum(map(len, by.values())) <= len(by) + max(1, 0.03 * len(rows))


def test_links_apart_from_the_fullest_text_are_found(spark):
    # Versions of one text that are too far from it and from each other, each with a near one of its own that changes its own words.
    rng = random.Random(21)
    base, rows = say(rng, 300), []
    for _ in range(150):
        own = changed(rng, base, 6)
        rows += [" ".join(own), " ".join(changed(rng, own, 4))]
    want = plain_groups(rows)
    assert len(set(want)) > 100
    got = {r.doc_id: r.label for r in similar.groups(frame(spark, list(enumerate(rows)))).collect()}
    assert len({(want[i], got[i]) for i in got}) == len(set(want)) == len(set(got.values()))


def test_every_pair_that_can_reach_the_similarity_is_verified(spark):
    rng, sets = random.Random(4), []
    for k in range(120):
        base = sets[rng.randrange(len(sets))] if sets and k % 3 else set()
        keep = set(rng.sample(sorted(base), int(len(base) * rng.choice([0.85, 0.95, 1]))))
        sets.append(keep | {rng.randrange(400 if k % 2 else 1 << 32) for _ in range(rng.choice([1, 2, 5, 9]) + (0 if base else 30))})
    label = [i // 2 * 2 for i in range(len(sets))]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if label[i] != label[j] and alike(sets[i], sets[j]) >= 0.8}
    rows = [(i, np.array(sorted(x), np.uint32).tobytes()) for i, x in enumerate(sets)]
    table = spark.createDataFrame(rows, "copy long, set binary").repartition(3)
    pairs = similar.apart(table, spark.createDataFrame(list(enumerate(label)), "copy long, label long"))
    tried = {(r.src, r.dst) for r in pairs.collect()}
    assert len(want) > 50 and want <= tried and all(label[i] != label[j] for i, j in tried)
    assert {(r.src, r.dst) for r in similar.verified(pairs, table).collect()} == want


def test_rows_that_share_an_id_stay(spark):
    rng = random.Random(5)
    a, b, c = (" ".join(say(rng, 50)) for _ in range(3))
    rows = [(1, a), (1, b), (2, c), (1, a), (3, a), (None, c), (None, "alone here"), (None, "alone here"), (4, None), (5, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in similar.one_of_each(frame(spark, rows)).collect())
    assert got == sorted([(1, a), (1, b), (2, c), (-1, "alone here"), (4, "")])


def test_awkward_documents(spark, tmp_path):
    data.write_all(tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = similar.one_of_each(docs)
    assert out.columns == docs.columns
    rows = sorted({(r.doc_id if r.doc_id is not None else 10**9, r.text or "") for r in docs.collect()})
    label = plain_groups([t for _, t in rows])
    want = {}
    for (i, t), g in zip(rows, label):
        want.setdefault(g, i)
    got = sorted(r.doc_id if r.doc_id is not None else 10**9 for r in out.collect())
    assert got == sorted(want.values())


def test_slabs_and_parts_make_no_difference(monkeypatch):
    rng = random.Random(1)
    texts = [" ".join(say(rng, n)) for n in (0, 1, 4, 5, 6, 3000, 40)]
    plain = [t.encode() for t in texts]
    buf, offsets = np.frombuffer(b"".join(plain), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in plain])])
    whole = list(similar.shingles(buf, offsets))
    alone = [x for i in range(len(texts)) for x in similar.shingles(buf, offsets[i:i + 2])]
    assert [(h.tolist(), c) for h, c in whole] == [(h.tolist(), c) for h, c in alone]
    one = [similar.positional(h).tolist() for h, _ in whole]
    monkeypatch.setattr(similar, "_PART", 7)
    assert one == [similar.positional(h).tolist() for h, _ in whole]


def test_simhash_links_are_a_step(spark, monkeypatch):
    rng = random.Random(8)
    a = say(rng, 400)
    near = [" ".join(a), " ".join(a[:-1] + ["other"]), " ".join(say(rng, 400))]
    fp = [similar.fingerprint(t.encode(), similar.SHINGLE) for t in near]
    assert bin(fp[0] ^ fp[1]).count("1") <= 2
    # Without the lists of shingle bytes the texts are still linked, by their fingerprints, and verified.
    monkeypatch.setattr(similar, "SHARED", 99)
    got = {r.doc_id: r.label for r in similar.groups(frame(spark, list(enumerate(near)))).collect()}
    assert got[0] == got[1] != got[2]
