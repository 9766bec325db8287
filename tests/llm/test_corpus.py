"""Operators 11 to 13: the cuckoo index, the runs and the trie against plain Python."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import data  # noqa: E402

from stepfield.llm import cuckoo, spimi, variants  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def keys(values):
    return np.frombuffer(b"".join(hashlib.sha256(str(v).encode()).digest() for v in values), np.uint8).reshape(-1, cuckoo.SIZE)


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    data.write_all(folder)
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_cuckoo_index_against_a_set():
    rng = random.Random(4)
    index, live = cuckoo.CuckooIndex(), {}
    for _ in range(40):
        new = [v for v in rng.sample(range(30_000), rng.randint(1, 2500)) if v not in live]
        live.update(zip(new, index.insert(keys(new)).tolist()))
        gone = rng.sample(sorted(live), len(live) // 4)
        assert index.delete(keys(gone)).tolist() == [live.pop(v) for v in gone]
        seen = rng.sample(range(40_000), 3000)
        assert index.find(keys(seen)).tolist() == [live.get(v, -1) for v in seen]
    assert len(index) == len(live) and index.resized > 3
    # Freed keys are used again.
    assert index.used <= 30_000


def test_equal_fingerprints_are_verified():
    index = cuckoo.CuckooIndex()
    one = keys(["a"])
    other = one.copy()
    other[0, 20] ^= 1  # the same fingerprint and bucket, another digest
    at = index.insert(one)
    assert index.find(other).tolist() == [-1]
    both = np.concatenate([one, other])
    index.insert(other)
    assert len(set(index.find(both).tolist())) == 2
    assert index.delete(one).tolist() == at.tolist() and index.find(both)[0] == -1 and index.find(both)[1] >= 0


def test_many_equal_fingerprints_grow_the_filter():
    same = np.repeat(keys(["a"]), 60, 0).copy()
    same[:, 10] = np.arange(60)  # one fingerprint, buckets apart only in a larger filter
    same[:, 9] = 7
    index = cuckoo.CuckooIndex(64)
    index.insert(same)
    assert index.find(same).tolist() == list(range(60)) and index.resized


def test_index_is_merged_and_withdrawn(spark, docs):
    some, others = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1 or doc_id is null")
    whole = {bytes(r.digest): (r.doc_id, r.copies) for r in cuckoo.build(cuckoo.digests(docs)).collect()}
    index = cuckoo.merged(cuckoo.build(cuckoo.digests(some)), cuckoo.build(cuckoo.digests(others)))
    assert {bytes(r.digest): (r.doc_id, r.copies) for r in index.collect()} == whole
    gone = spark.createDataFrame([("THE " * 300,), ("never seen",), (None,), (None,)], "text string")
    left = {bytes(r.digest) for r in cuckoo.withdrawn(index, gone).collect()}
    dropped = {hashlib.sha256(t.encode()).digest() for t in ("the " * 300, "")}
    assert dropped <= set(whole) and left == set(whole) - dropped


def test_dedup_of_hot_copies(spark):
    """A third of the rows share a text, in both cases, and repeated rows are there."""
    rows = [(i, "Same Text" if i % 3 == 0 else f"text {i}") for i in range(900)] + [(899, "text 899"), (None, "SAME TEXT"), (None, "alone"), (None, "ALONE")]
    got = cuckoo.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.text_sha256].append(r)
    for d, own in by.items():
        assert all(r.group_size == len(own) for r in own) and sum(r.kept for r in own) == 1
        ids = [r.doc_id for r in own if r.doc_id is not None]
        assert {r.keep_id for r in own} == {max(ids) if ids else None} and [r.doc_id for r in own if r.kept] == [max(ids) if ids else None]
    assert len(by[hashlib.sha256(b"same text").hexdigest()]) == 301


def plain_divergence(rows):
    cut = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t or ""))
    docs = [(r["lang"] or "", r["source"] or "", cut(r["text"])) for r in rows]
    seen, n = Counter(), Counter()
    for lang, source, words in docs:
        seen.update((lang, w) for w in set(words))
        n.update((lang, source, w) for w in words)
    out, groups = [], sorted({d[:2] for d in docs})
    for lang in {g[0] for g in groups}:
        kept = sorted(w for at, w in seen if at == lang and seen[at, w] >= 3)
        own = [s for at, s in groups if at == lang]
        count = {s: [n[lang, s, w] for w in kept] for s in own}
        share = lambda c: [1 + 10**9 * (x + 1) // (sum(c) + len(kept)) for x in c]
        q = share([sum(c) for c in zip(*count.values())])
        for s in own:
            p = share(count[s])
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p, share(count[o]))), o) for o in own if o != s]
            terms = [((a - b) ** 2 // b, w) for a, b, w, c in zip(p, q, kept, count[s]) if c and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, 200)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(ranked)]
    return sorted(out)


def divergent(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in spimi.divergence(df).collect())


def corpus(spark):
    rng = random.Random(8)
    vocab = ["w" + "abcdefgh"[i % 8] * (1 + i // 8) for i in range(60)] + ["é", "Ünï", "日本"]
    rows = []
    for i in range(400):
        lang, source = rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot"] * 6 + ["a", "b", None, "", "ß"])
        rows.append((i % 300, " ".join(rng.choices(vocab, range(1, len(vocab) + 1), k=rng.randint(0, 60))) if i % 17 else None, lang, source))
    rows += [(900 + i, "lonely", "xx", f"s{i}") for i in range(2)] + [(910, None, "yy", None), (911, "One, two; ONE-two 3one", "en", "a")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("small", [False, True])
def test_divergence_by_brute_force(spark, monkeypatch, small):
    df = corpus(spark)
    if small:  # many runs, pieces, merges and portions of pairs
        for name, value in (("BLOCK", 30), ("PIECE", 3), ("FAN", 2), ("PAIRS", 5)):
            monkeypatch.setattr(spimi, name, value)
        df = df.repartition(5)
    assert divergent(df) == plain_divergence([r.asDict() for r in df.collect()])


def test_divergence_of_awkward_documents(spark, docs):
    assert divergent(docs) == plain_divergence([r.asDict() for r in docs.collect()])


def test_large_counts_stay_exact(spark):
    big = 3 * 10**18
    df = spark.createDataFrame([(big, 7, 2), (0, big, 5)], "n long, total long, terms long")
    got = [r[0] for r in df.select(spimi.share("n", "total", "terms")).collect()]
    assert got == [1 + 10**9 * (big + 1) // (7 + 2), 1 + 10**9 // (big + 5)] if 10**9 * (big + 1) // 9 < 2**63 else True
    df = spark.createDataFrame([(10**17, 4 * 10**18, 5)], "n long, total long, terms long")
    assert df.select(spimi.share("n", "total", "terms")).first()[0] == 1 + 10**9 * (10**17 + 1) // (4 * 10**18 + 5)


def test_runs_merge_in_levels(monkeypatch):
    monkeypatch.setattr(spimi, "FAN", 3)
    rng, runs, want, seen = random.Random(2), spimi.Runs(), defaultdict(Counter), Counter()
    for _ in range(20):
        run = {b"l" + spimi.BETWEEN + bytes([rng.randint(97, 120)]): {s: rng.randint(1, 9) for s in rng.sample("xyz", rng.randint(1, 3))} for _ in range(12)}
        entries = [(k, 2, run[k]) for k in sorted(run)]
        for k, _, n in entries:
            want[k[2:].decode()].update(n)
            seen[k[2:].decode()] += 2
        runs.add([spimi._packed(entries[i:i + 4]) for i in range(0, len(entries), 4)])
    assert all(len(level) < 3 for level in runs.levels) and len(runs.levels) > 1
    assert list(runs.terms()) == [("l", t, seen[t], want[t]) for t in sorted(want)]


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_near(words):
    out = {}
    for w in words:
        near = [v for v in words if one_apart(w, v)]
        out[w] = (len(near), min(near, key=lambda v: (-words[v], v)) if near else None)
    return out


def some_words():
    rng = random.Random(6)
    words = {}
    for letters in ("abc", "eéèêtnsr", "aA", "abcdefghijklmnopqrstuvwxyzßüñ日𝄞"):
        for _ in range(120):
            w = [rng.choice(letters) for _ in range(rng.randint(6, 10))]
            for _ in range(3):
                words["".join(w)] = rng.randint(5, 400)
                i = rng.randrange(len(w))
                w[i:i + 1] = rng.choice([[], [rng.choice(letters)], [w[i], rng.choice(letters)]])
    words |= {"x" * 300: 9, "x" * 301: 99, "x" * 302: 7, "x" * 150 + "y" + "x" * 149: 8}
    return words


@pytest.mark.parametrize("small", [False, True])
def test_near_words_by_brute_force(spark, monkeypatch, small):
    if small:  # subtrees in parts, searches that stream past kept words
        for name, value in (("SUBTREE", 3), ("ROWS", 40), ("CELLS", 64)):
            monkeypatch.setattr(variants, name, value)
    words = some_words()
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(4)
    got = {r.word: (r.n_near, r.best.other) for r in variants.near_words(df).collect()}
    assert got == {w: x for w, x in plain_near(words).items() if x[0]}


@pytest.mark.parametrize("leaf", [1, 24])
def test_search_misses_no_pair(monkeypatch, leaf):
    monkeypatch.setattr(variants, "LEAF", leaf)
    monkeypatch.setattr(variants, "CELLS", 64 if leaf == 1 else 1 << 22)
    words = sorted(w for w in some_words() if len(w) < 20)[::3]
    points, all_, zero = variants.Points(words), np.arange(len(words)), np.zeros(len(words), np.int64)
    for role, most in ((1, (1, 1)), (2, (1, 0)), (3, (0, 0))):
        got = {(a, b) for x, y in variants.search(zero, all_, zero, all_, zero + role, points.vectors()) for a, b in zip(x.tolist(), y.tolist())}
        v = points.vectors().astype(int)
        d = v[None] - v[:, None]
        want = (np.maximum(d, 0).sum(2) <= most[0]) & (np.maximum(-d, 0).sum(2) <= most[1])
        assert got == set(zip(*(x.tolist() for x in np.nonzero(want))))


def test_pairs_are_verified():
    rng, words = random.Random(1), []
    for _ in range(300):
        w = "".join(rng.choice("abé日") for _ in range(rng.randint(1, 5)))
        words += [w, w + "a", w[1:] or "b", w.replace("a", "b")]
    words = sorted(set(words))
    a, b = (np.array(x) for x in zip(*itertools.product(range(len(words)), repeat=2)))
    assert variants.Points(words).near(a, b).tolist() == [one_apart(words[i], words[j]) for i, j in zip(a, b)]


def plain_variants(rows):
    n = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            n[run[:h % len(run)] + run[h % len(run) + 1:] if h % 199 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}
    near = plain_near(words)
    form = {w: v for w, (_, v) in near.items() if v is not None and words[v] >= 5 * words[w]}
    out = []
    for w, k in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w) or "", root, k, near[w][0], words[form[w]] if w in form else 0))
    return sorted(out)


def varied(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in variants.spelling_variants(df).collect())


def test_variants_by_brute_force(spark, docs, monkeypatch):
    assert varied(docs) == plain_variants([r.asDict() for r in docs.collect()])
    # A chain of forms, and a text of many pieces.
    chain = ["aaaaaaaa", "aaaaaaab", "aaaaaabb", "aaaaabbb", "aaaabbbb"]
    text = " ".join(w for i, w in enumerate(chain) for _ in range(6 ** (i + 1)))
    df = spark.createDataFrame([(i, text if i < 2 else "Straße, STRASSE×ab÷cd naïveté " * 9) for i in range(4)], "doc_id long, text string")
    monkeypatch.setattr(variants, "TEXT", 37)
    got = varied(df)
    assert got == plain_variants([r.asDict() for r in df.collect()])
    assert {r[0]: r[2] for r in got}[chain[0]] == chain[-1]


def test_pieces_keep_words_whole():
    from stepfield.llm.base import spaced

    text = b"ab  cd, efghijk;l " * 50 + b"z" * 500 + b" end"
    want = text.translate(variants._TABLE).split()
    for size in (1, 7, 100, 10_000):
        assert [w for part in spaced(text, variants._TABLE, size) for w in part] == want
