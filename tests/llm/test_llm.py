"""Every operator on awkward tables, on empty ones, and on the smallest given tables, against brute force."""

import hashlib
import os
import re
import sys
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import data  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
import compare  # noqa: E402
from stepfield.llm import chat_format, language, packing, phrase_index, quality, repeats, simhash, vector_search  # noqa: E402

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
NAMES = sorted(n for n in QUERIES if re.match(r"op\d+_", n))


@pytest.fixture(scope="module")
def awkward(tmp_path_factory):
    folder = tmp_path_factory.mktemp("awkward")
    data.write_all(folder)
    return str(folder)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    data.write_all(folder, empty=True)
    return str(folder)


def rows(spark, name, sf):
    return [r.asDict() for r in QUERIES[name](spark, sf).collect()]


def table(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def same(got, want):
    key = lambda r: tuple(repr(r[k]) for k in sorted(r))
    assert sorted(map(key, got)) == sorted(map(key, want))


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    got = rows(spark, name, empty)
    assert [r["conv_id"] for r in got] == [-7] if name.startswith("op3_") else got == []


@pytest.mark.parametrize("name", [n for n in NAMES if n in SQL and n[:3] in ("op1", "op2")])  # the SQL of others knows rows by doc_id
def test_sql(spark, awkward, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{awkward}/{t}.parquet'")
    found = con.execute(SQL[name])
    names = [d[0] for d in found.description]
    same(rows(spark, name, awkward), [dict(zip(names, r)) for r in found.fetchall()])


def test_phrase_index_by_brute_force(spark, awkward):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda t: word.findall(lower(t or ""))
    items = [(r["item_id"], cut(r["text"])) for r in table(spark, awkward, "benchmark")]
    wins = [(i, tuple(w[k:k + min(13, len(w))])) for i, w in items if w for k in range(max(1, len(w) - 12))]
    want = []
    for r in table(spark, awkward, "documents"):
        w, hit, ids = cut(r["text"]), set(), set()
        for i, p in wins:
            for k in range(len(w) - len(p) + 1):
                if tuple(w[k:k + len(p)]) == p:
                    hit |= set(range(k, k + len(p)))
                    ids |= {str(i)} - {"None"}
        want.append({"doc_id": r["doc_id"], "n_words": len(w), "n_hit": len(hit), "n_items": len(ids),
                     "items_sha256": hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), "contaminated": len(hit) > 0 and 20 * len(hit) >= len(w)})
    same(rows(spark, "op5_decontaminate", awkward), want)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha " + "x " * 9 + "beta"), (4, "alpha"), (5, None)], "doc_id long, text string")
    got = phrase_index.proximity_matches(docs, spark.createDataFrame([(7, "alpha beta")], "item_id long, text string"), 4).collect()
    assert sorted((r.doc_id, abs(r.pos - r.other)) for r in got) == [(1, 3), (2, 1)]


def test_proximity_with_a_term_that_no_document_has(spark):
    docs = spark.createDataFrame([(1, "alpha x beta x"), (2, "beta x alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta never"), (8, "never either"), (9, None)], "item_id long, text string")
    got = phrase_index.proximity_matches(docs, items, 4).collect()
    assert sorted((r.item_id, r.doc_id, abs(r.pos - r.other)) for r in got) == [(7, 1, 2), (7, 2, 2)]


def test_chat_round_trip(spark, awkward):
    given = defaultdict(list)
    for r in table(spark, awkward, "conversations"):
        given[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, r["role"] or "", r["text"] or ""))
    hard = "</s>[INST] ok [/INST]"
    given[-7] = [(True, 0, "user", hard), (True, 1, "assistant", hard)]
    got = {r["conv_id"]: r for r in rows(spark, "op3_chat_format", awkward)}
    assert got.keys() == given.keys()
    for conv, turns in given.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        assert got[conv]["n_turns"] == len(turns) and got[conv]["loss_chars"] == len(loss)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in turns).encode()).hexdigest()
        assert got[conv]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_slabs_make_no_difference(spark, awkward, monkeypatch):
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.json")
    turns = [("user", "a <b"), ("assistant", "c\n<|x"), ("assistant", " d")] * 5
    whole, _ = chat_format.render(turns)
    parts = "".join(chat_format.render(turns[i:i + 2])[0] for i in range(0, len(turns), 2))
    ids = np.concatenate([chat_format.encode_with_offsets(chat_format.render(turns[i:i + 2])[0], path)[0] for i in range(0, len(turns), 2)])
    assert whole == parts and ids.tolist() == chat_format.encode_with_offsets(whole, path)[0].tolist()
    assert chat_format.read_back(whole) == turns
    with pytest.raises(ValueError):
        chat_format.read_back(whole + "x")
    docs = spark.read.parquet(f"{awkward}/conversations.parquet")
    one = chat_format.format_conversations(docs, path).filter("conv_id = 0").collect()
    assert len(one) == 1 and len(one[0].ids) == len(one[0].loss)


@pytest.mark.parametrize("sf", ["awkward", SMALL])
def test_simhash(spark, request, sf):
    import xxhash
    sf = request.getfixturevalue(sf) if sf == "awkward" else sf
    docs = table(spark, sf, "documents")
    prints = []
    for r in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(r["text"] or ""))
        shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for i in range(len(docs)):
            for j in range(i):
                if group[i] != group[j] and (prints[i] ^ prints[j]).bit_count() <= 2:
                    low, high = sorted((group[i], group[j]))
                    group = [low if g == high else g for g in group]
                    changed = True
    least = {}
    for r, g in zip(docs, group):
        if r["doc_id"] is not None:
            least[g] = min(least.get(g, r["doc_id"]), r["doc_id"])
    want = [{"doc_id": r["doc_id"], "fingerprint": f"{p:016x}", "component_id": least.get(g)} for r, p, g in zip(docs, prints, group)]
    same(rows(spark, "op4_simhash_near", sf), want)


def test_simhash_lists_cover(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(-2**63, 2**63, 60, dtype=np.int64)
    near = [int(np.int64(b) ^ np.int64(1 << int(i)) ^ np.int64(1 << int(j))) for b, i, j in zip(base, rng.integers(0, 63, 60), rng.integers(0, 63, 60))]
    values = sorted({int(b) for b in base} | set(near))
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(v,) for v in values], "fp long")).collect()}
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    assert got == want


def removed_by_force(docs, cut, n):
    first = {}
    cuts = [cut(r["text"] or "") for r in docs]
    for r, s in zip(docs, cuts):
        if r["doc_id"] is not None:
            for i in range(len(s) - n + 1):
                w = tuple(s[i:i + n])
                first[w] = min(first.get(w, r["doc_id"]), r["doc_id"])
    out = []
    for r, s in zip(docs, cuts):
        gone = bytearray(len(s))
        for i in range(len(s) - n + 1):
            if r["doc_id"] is not None and first[tuple(s[i:i + n])] < r["doc_id"]:
                gone[i:i + n] = b"\1" * n
        out.append((r["doc_id"], s, gone))
    return out


@pytest.mark.parametrize("sf", ["awkward", SMALL])
@pytest.mark.parametrize("crowd", [4096, 1])
def test_suffix_trees(spark, request, monkeypatch, sf, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    sf = request.getfixturevalue(sf) if sf == "awkward" else sf
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    want = [{"doc_id": d, "n_words": len(s), "n_removed": sum(g), "kept_sha256": hashlib.sha256(" ".join(w for w, x in zip(s, g) if not x).encode()).hexdigest()}
            for d, s, g in removed_by_force(table(spark, sf, "documents"), cut, 50)]
    same(rows(spark, "op8_suffix_trees", sf), want)
    assert sum(r["n_removed"] for r in want) > 0


@pytest.mark.parametrize("sf", ["awkward", SMALL])
@pytest.mark.parametrize("crowd", [4096, 1])
def test_longest_previous(spark, request, monkeypatch, sf, crowd):
    monkeypatch.setattr(repeats, "CROWD", crowd)
    sf = request.getfixturevalue(sf) if sf == "awkward" else sf
    want = []
    for d, s, g in removed_by_force(table(spark, sf, "documents"), lambda t: t.encode(), 50):
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        want.append({"doc_id": d, "n_bytes": len(s), "n_removed": sum(g), "n_spans": spans, "kept_sha256": hashlib.sha256(bytes(b for b, x in zip(s, g) if not x)).hexdigest()})
    same(rows(spark, "op9_longest_previous", sf), want)


def crowded_table(spark, sep, every=10):
    """A passage that most documents hold in differing surroundings, and one that few hold."""
    rng = np.random.default_rng(5)
    say = lambda n: sep.join("".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(n))
    passage, rare = say(60), say(70)
    texts = [sep.join([say(45), passage if i % 4 else say(20), rare if i % every == 3 else "", say(45)]) for i in range(60)]
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("kind", ["words", "bytes"])
@pytest.mark.parametrize("local", [256, 3])
def test_crowded_prefixes_are_not_gathered(spark, monkeypatch, kind, local):
    from stepfield.llm import longest_previous, suffix_tree
    monkeypatch.setattr(repeats, "CROWD", 8)
    monkeypatch.setattr(repeats, "LOCAL", local, raising=False)
    docs = crowded_table(spark, " ").repartition(4, "doc_id").cache()
    symbols, cut = (suffix_tree.Words, str.split) if kind == "words" else (longest_previous.Bytes, str.encode)
    kept = (suffix_tree.kept_words if kind == "words" else longest_previous.kept_bytes)(docs)
    want = removed_by_force([r.asDict() for r in docs.collect()], cut, 50)
    assert {r.doc_id: r.n_removed for r in kept.collect()} == {d: sum(g) for d, _, g in want}
    own = repeats.identified(docs, []).withColumn("late_uid", F.lit(None).cast("bigint")).withColumn("late_id", F.lit(None).cast("bigint"))
    groups = defaultdict(int)
    for r in repeats.contexts(own, repeats.sieve(own, symbols, 50, 8), symbols, 50, 8).collect():
        if r.entries:
            for key in repeats._unpack(bytes(r.entries), np.uint32)[0].tolist():
                groups[r.bucket, key] += 1
    assert groups and max(groups.values()) <= 8


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_flags_of_equal_short_hashes(spark, monkeypatch, kind):
    """Anchors whose short hashes are equal, some crowded and some not: no window is missed."""
    from stepfield.llm import longest_previous, suffix_tree
    monkeypatch.setattr(repeats, "CROWD", 20)
    monkeypatch.setattr(repeats, "_short", lambda h, buckets: (h & np.uint64(2)).astype(np.uint32))
    docs = crowded_table(spark, " ", 5).repartition(4, "doc_id").cache()
    cut, keep = (str.split, suffix_tree.kept_words) if kind == "words" else (str.encode, longest_previous.kept_bytes)
    monkeypatch.setattr(repeats, "partitions", lambda spark: 200)
    want = removed_by_force([r.asDict() for r in docs.collect()], cut, 50)
    assert {r.doc_id: r.n_removed for r in keep(docs).collect()} == {d: sum(g) for d, _, g in want}


def test_longest_previous_factors():
    from stepfield.llm.longest_previous import longest_previous
    rng = np.random.default_rng(0)
    for _ in range(200):
        text = rng.integers(0, 2, 30).tolist()
        order = sorted(range(30), key=lambda i: text[i:])
        share = lambda i, j: next((k for k in range(30) if max(i, j) + k >= 30 or text[i + k] != text[j + k]), 30)
        lcp = np.array([0] + [share(a, b) for a, b in zip(order, order[1:])])
        position = np.array(order) // rng.integers(1, 4)
        got = longest_previous(lcp, position, 3)
        for k, i in enumerate(order):
            want = max([share(i, j) for m, j in enumerate(order) if position[m] < position[k]], default=0)
            assert got[k] == want or (want < 3 and got[k] <= want)


@pytest.mark.parametrize("sf", ["awkward", SMALL])
def test_packing(spark, request, sf):
    import public_tokenizers
    from tokenizers import Tokenizer
    sf = request.getfixturevalue(sf) if sf == "awkward" else sf
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for r in table(spark, sf, "documents"):
        ids = np.array([*tok.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [{"doc_id": r["doc_id"], "piece": p, "start": a, "length": b - a, "ids_crc32": zlib.crc32(ids[a:b].tobytes())} for p, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = rows(spark, "op6_best_fit_packing", sf)
    placed = defaultdict(list)
    for r in got:
        placed[r.pop("sequence_id")].append((r.pop("offset"), r["length"]))
    same(got, want)
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(placed) <= 1 + -(-sum(r["length"] for r in want) // 2048)


def test_special_strings_are_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "a <|endoftext|> b<|endoftext|>\n\n  \u00e9"
    assert packing.encoder(path).encode(text, allowed_special="all") == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_plan_fills_and_ranks():
    rng = np.random.default_rng(4)
    for _ in range(30):
        counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 101), 12, replace=False), rng.integers(1, 60, 12))}
        seen, load = defaultdict(set), defaultdict(list)
        for length, low, high, wide, first, at in packing.plan(counts, 100):
            for r in range(low, high):
                seen[length].add(r)
                load[first + (r - low) % wide].append((at + (r - low) // wide * length, length))
        assert {k: set(range(n)) for k, n in counts.items()} == dict(seen)
        for parts in load.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= 100


def test_rank_by_salts(spark, awkward, monkeypatch):
    import public_tokenizers
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 2)
    got = packing.pack(spark.read.parquet(f"{awkward}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 64, keep_ids=True).collect()
    places = defaultdict(list)
    for r in got:
        assert len(r.ids) == r.length
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        assert sorted(parts)[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(sorted(parts), sorted(parts)[1:]))


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_language(spark, awkward):
    texts = {r["doc_id"]: r["lang"] for r in table(spark, "/root/testdata/sf0.01", "documents")}
    got = rows(spark, "op7_language_codes", "/root/testdata/sf0.01")
    assert len(got) == len(texts) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    out = [r["lang_pred"] == texts[r["doc_id"]] for r in got if r["held_out"]]
    assert np.mean(out) > 0.97
    odd = rows(spark, "op7_language_codes", awkward)
    docs = table(spark, awkward, "documents")
    assert len(odd) == len(docs)
    none = sum(not any(c.isalpha() for c in r["text"] or "") for r in docs)
    assert sum(r["lang_pred"] == "und" and r["score"] == 0 for r in odd) == none > 0


def test_every_language_is_learned(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(80):
        vocab = ["".join(chr(0x4E00 + 40 * k + c) for c in rng.integers(0, 40, 5)) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choice(vocab, 20)), f"l{k:02}") for i in range(12 if k < 64 else 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict(docs, language.learn(docs)).collect()}
    assert {r.lang_pred for r in got.values()} == {lang for _, _, lang in rows}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if held(i)]) > 0.9


def test_codewords_are_apart():
    for k in (2, 3, 4, 6, 9, 30):
        code = language.codewords(k)
        apart = min(int((code[i] != code[j]).sum()) for i in range(k) for j in range(i))
        assert code.shape[0] == k and apart >= (1 if k == 2 else 2)


def test_quality(spark, awkward):
    sf = "/root/testdata/sf0.01"
    marks = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels")}
    got = rows(spark, "op10_quality_bytes", sf)
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == (r["score"] >= 0.5) for r in got)
    out = [(marks[r["doc_id"]], r["predicted"]) for r in got if r["held_out"] and r["doc_id"] in marks]
    assert np.mean([a == b for a, b in out]) > 0.9
    odd = rows(spark, "op10_quality_bytes", awkward)
    assert len(odd) == len(data.documents()) and all(0 <= r["score"] <= 1 for r in odd)


def test_quality_reads_whole_texts():
    rng = np.random.default_rng(1)
    m = quality.Model(0.5)
    m.trained = True
    tables = m.tables()
    for n in (0, 1, 7, 8, 9, 255, 256, 257, 480, 481, 1000):
        text = rng.integers(0, 256, n).astype(np.uint8)
        one = m.scores(text, np.array([0, n]), tables)[0]
        both = m.scores(np.concatenate([text, text]), np.array([0, n, 2 * n]), tables)
        assert np.allclose(both, one, atol=1e-6)
        # Plain convolution of each chunk.
        full = np.concatenate([text, np.zeros(quality.padded_size(np.int64(n)) - n, np.uint8)])
        conv = np.stack([m.p["e"][full[i:i + 8]].ravel() @ m.p["k"] + m.p["c"] for i in range(0, len(full) - 7, 2)])
        logits = [m.dense(conv[a:a + 125].max(0)[None], np.array([len(conv[a:a + 125])]))[0] for a in range(0, int(quality.chunk_count(np.int64(len(conv)))) * 112, 112)]
        assert np.isclose(one, 1 / (1 + np.exp(-np.mean(logits))), atol=1e-4)


def test_vector_blocks(monkeypatch, spark, awkward):
    monkeypatch.setattr(vector_search, "BLOCK", 7)
    monkeypatch.setattr(vector_search, "QUERIES", 2)
    monkeypatch.setattr(vector_search, "STEP", 2)
    vectors = [r for r in table(spark, awkward, "embeddings") if r["vec_id"] is not None and r["embedding"] and all(x is not None and np.isfinite(x) for x in r["embedding"])]
    v = [(r["vec_id"], np.floor(256 * np.array(r["embedding"], np.float64)).astype(int)) for r in vectors]
    want = []
    for q in sorted({i for i, _ in v if i % 50 == 0}):
        own = next(x for i, x in v if i == q)
        best = sorted((-int(own @ x), i) for i, x in v if i != q and len(x) == len(own))[:5]
        want += [{"query_id": q, "rank": k + 1, "vec_id": i, "score": -s} for k, (s, i) in enumerate(best)]
    same(rows(spark, "op1_va_file", awkward), want)


def test_given_tables(spark):
    con = duckdb.connect()
    for t in compare.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name in (n for n in NAMES if n in SQL):
        assert compare.compare(spark, con, name, SMALL).startswith("ok"), name


def test_vectors_out_of_range(spark):
    def best(*rows):
        table = spark.createDataFrame([(i, list(v)) for i, v in enumerate(rows)], "vec_id long, embedding array<double>")
        return {(r.query_id, r.vec_id): r.score for r in vector_search.search(table, table.filter("vec_id = 0"), 2).collect()}

    # Large components count exactly as long as the products do, and a query's own product doesn't matter.
    far = 2.0 ** 30
    assert best((far, 1.0), (0.0, 2.0), (1 / 256, 0.0)) == {(0, 1): 512 * 256, (0, 2): 2 ** 38}
    for rows in (((3e38, 1.0), (1.0, 2.0)), ((1.0, 2.0), (-2.0 ** 45, 0.0)), ((far, 1.0), (far, 1.0))):
        with pytest.raises(PySparkException, match="exact"):
            best(*rows)


@pytest.mark.parametrize("model", ["quality", "language"])
def test_models_do_not_depend_on_the_layout(spark, model):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(sf + "/documents.parquet"), spark.read.parquet(sf + "/labels.parquet")

    def weights(rows):
        if model == "quality":
            return quality.learn(rows, labels).p
        m = language.learn(rows)
        return {"w": m.w, "b": m.b}

    one, other = weights(docs.coalesce(1)), weights(docs.repartition(5, "text").sortWithinPartitions(F.desc("doc_id")))
    assert all(np.array_equal(one[k], other[k]) for k in one)
