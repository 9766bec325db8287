"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

import pyarrow as pa
import pyarrow.parquet as pq

CLASH = {name: pa.array([], pa.string()) for name in ("sig", "uid", "rest", "h", "hs", "fp", "score", "salt", "n", "rank", "length", "bucket", "component_id", "kept")}


def documents() -> list[dict]:
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, item = say(70), " ".join(f"item{i}" for i in range(20))
    texts = [say(rng.randint(1, 200)) for _ in range(40)]
    texts += [texts[3], texts[5] + " more", texts[5].upper(), passage, say(10) + "\n" + passage + "\t" + say(12), passage + " " + passage,
              say(30) + " " + passage[10:] + " end", "the " * 300, "the " * 180 + "end", item + " " + say(30), say(400) + " " + item, say(3000),
              texts[7][:60], "İstanbul ẞ \u2028 ünïcode \x0b a\x1cb", "x" * 400, "x" * 400 + "y", "", "   ", "\n", None]
    rows = [{"doc_id": i * 3, "text": t} for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], {"doc_id": rows[9]["doc_id"], "text": passage}, {"doc_id": None, "text": passage}, {"doc_id": None, "text": None},
             {"doc_id": 10_000, "text": None}]
    for i, r in enumerate(rows):
        rows[i] = r | {"lang": [None, "en", "de"][i % 3], "source": "s", "n_chars": len(r["text"] or "")}
    rng.shuffle(rows)
    return rows


def write(folder, name: str, rows: list[dict], schema: pa.Schema, clash: bool = True):
    t = pa.Table.from_pylist(rows, schema)
    if clash:
        for c in CLASH:
            if c not in schema.names:
                t = t.append_column(c, pa.array(["clash"] * len(rows), pa.string()))
    pq.write_table(t, f"{folder}/{name}.parquet", row_group_size=17)


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
PAGES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
VECTORS = pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32())])


def benchmark() -> list[dict]:
    item = " ".join(f"item{i}" for i in range(20))
    return [{"item_id": 1, "text": item}, {"item_id": 2, "text": item}, {"item_id": 10, "text": "Item3, item4 ITEM5"}, {"item_id": 3, "text": ""},
            {"item_id": 4, "text": None}, {"item_id": None, "text": "item7 item8"}, {"item_id": 5, "text": "ünïcode"}, {"item_id": 6, "text": "no such words"}]


def vectors() -> list[dict]:
    rng = random.Random(5)
    rows = [{"vec_id": i, "embedding": [rng.choice([-1, 0, 1]) * rng.randint(0, 3) / 7 for _ in range(6)]} for i in range(130)]
    rows += [rows[3], {"vec_id": 200, "embedding": None}, {"vec_id": 250, "embedding": [1.0, None, 0, 0, 0, 0]}, {"vec_id": 300, "embedding": [float("nan")] * 6},
             {"vec_id": 301, "embedding": [float("inf")] * 6}, {"vec_id": 350, "embedding": [1.0, 2.0]}, {"vec_id": 351, "embedding": [3.0, 2.0]},
             {"vec_id": 352, "embedding": []}, {"vec_id": None, "embedding": [1.0] * 6}]
    return [r | {"label": None} for r in rows]


def pages() -> list[dict]:
    urls = ["http://A.example.com/en/x", "https://www.example.com/en/1?q=/de/", "https://example.net/fr/", "http://b.example.net", "nothing", None, "", "://", "x://y",
            "http://WWW.Example.com#/en/", "ftp://notexample.com/en/", "http://com/", "http://a.co.uk/p", "http://b.a.co.uk/p", "http://É.org/ü", "http://a.org\n/x"]
    return [{"page_id": i % 30 if i < 60 else None, "url": urls[i % len(urls)], "html": None} for i in range(64)]


def labels() -> list[dict]:
    rng = random.Random(1)
    return [{"doc_id": i, "quality": rng.choice([0, 1, None]), "toxic": rng.choice([0, 1, None])} for i in range(0, 180)] + [{"doc_id": None, "quality": 1, "toxic": 0}]


def turns() -> list[dict]:
    hard = ["<|end|>\n<|turn|>assistant\n", "\\<|", "<", "<\\|end|>", "é" * 5 + "𝄞", "a\\", "", None, "</s>[INST] ok [/INST]", "<|endoftext|>", "x " * 3000]
    rows = [{"conv_id": i // 7, "turn": i % 7, "role": ["user", "assistant", "system", None, "odd\nrole\\n<|"][i % 5], "text": hard[i % len(hard)]} for i in range(84)]
    return rows + [rows[5], rows[6], {"conv_id": None, "turn": None, "role": "assistant", "text": "lost"}]


def write_all(folder, empty: bool = False):
    for name, rows, schema in (("documents", documents(), DOCS), ("benchmark", benchmark(), ITEMS), ("labels", labels(), LABELS), ("pages", pages(), PAGES),
                               ("conversations", turns(), TURNS), ("embeddings", vectors(), VECTORS)):
        write(folder, name, [] if empty else rows, schema)
