"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole and encoded once with offsets. The spans of the assistant texts (sorted)
are intersected with the spans of the tokens (sorted) by binary search; the loss mask is exact to the character,
also where a token reaches over the edge of a turn or a character is split over tokens.

Template of a turn: ``<|turn|>`` role newline text ``<|end|>`` newline. Inside roles and texts a backslash is
written twice and ``<|`` as ``<\\|``, so no text can open or close a turn; roles also write a newline as
``\\n``. Reading back undoes all of it.

Rows are dealt by conversation and sorted by turn (ties by role, then text), and a conversation is encoded and
hashed turn by turn in slabs of at least ``SLAB`` characters, cut between turns where the tokeniser starts anew
anyway: a conversation of any length needs the memory of one slab and of its mask. The digests of one
conversation are sequential, so its rows stay with one task.

Edge cases: a null text or role is empty; rows with a null conv_id are one conversation, and null turns come
first; repeated rows are turns of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, END = "<|turn|>", "<|end|>"
SLAB = 1 << 20
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\([\\|])", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], role)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The formatted text, and the (start, end) of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape_role(role)}\n", escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def loss_mask(tokens: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that touch a span, and the pieces (start, end) of the text they cover inside spans, each once.

    Both lists are sorted and spans don't overlap: the first span that ends after a token starts, and the
    first that starts at or after its end, are found by binary search.
    """
    if not len(tokens) or not len(spans):
        return np.zeros(len(tokens), bool), np.zeros((0, 2), np.int64)
    first = np.searchsorted(spans[:, 1], tokens[:, 0], side="right")
    last = np.searchsorted(spans[:, 0], tokens[:, 1], side="left")
    many = np.maximum(last - first, 0)
    token = np.repeat(np.arange(len(tokens)), many)
    span = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many) + first[token]
    start = np.maximum(tokens[token, 0], spans[span, 0])
    end = np.minimum(tokens[token, 1], spans[span, 1])
    # Tokens of one character share its offsets: what an earlier piece has covered goes.
    start = np.maximum(start, np.concatenate([[0], np.maximum.accumulate(end)[:-1]]))
    return many > 0, np.stack([start, end], 1)[start < end]


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def encode_with_offsets(text: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    e = tokenizer(path).encode(text, add_special_tokens=False)
    return np.array(e.ids, np.int32), np.array(e.offsets, np.int64).reshape(-1, 2)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; fails if it isn't one."""
    turns, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            break
        turns.append((unescape_role(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("not a formatted conversation")
    return turns


def _by_conversation(rows: DataFrame) -> DataFrame:
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return own.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, part, text, ids, loss: the formatted slabs of each conversation with tokens and token mask."""
    import pyarrow as pa

    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for conv, part, turns, _ in _slabs(batches):
            text, spans = render(turns)
            ids, tokens = encode_with_offsets(text, path)
            mask, _ = loss_mask(tokens, spans)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([conv]), pa.array([part], pa.int32()), pa.array([text]), pa.array([ids], pa.list_(pa.int32())),
                 pa.array([mask], pa.list_(pa.bool_()))], ["conv_id", "part", "text", "ids", "loss"])

    return _by_conversation(rows).mapInArrow(run, f"conv_id {kind}, part int, text string, ids array<int>, loss array<boolean>")


def _slabs(batches: Iterator) -> Iterator[tuple]:
    """(conv_id as an array of one, number of the slab, its turns, whether it is the conversation's last)."""
    conv, key, part, turns, size = None, None, 0, [], 0
    for batch in batches:
        ids = batch.column("conv_id")
        for i, (k, role, text) in enumerate(zip(ids.to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())):
            if conv is None or k != key:
                if conv is not None:
                    yield conv, part, turns, True
                conv, key, part, turns, size = ids.slice(i, 1), k, 0, [], 0
            if size >= SLAB:
                yield conv, part, turns, False
                part, turns, size = part + 1, [], 0
            turns.append((role, text))
            size += len(role) + len(text)
    if conv is not None:
        yield conv, part, turns, True


def digests(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all read back from the formatted text."""
    import pyarrow as pa

    kind = rows.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator) -> Iterator:
        done: list[list] = [[] for _ in names]

        def flush():
            out = [pa.concat_arrays(done[0])] + [pa.array(c, pa.string() if "sha" in n else pa.int64()) for c, n in zip(done[1:], names[1:])]
            return pa.RecordBatch.from_arrays(out, names)
        n = chars = loss = 0
        all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
        for conv, _, turns, last in _slabs(batches):
            text, spans = render(turns)
            _, tokens = encode_with_offsets(text, path)
            _, pieces = loss_mask(tokens, spans)
            for role, own in read_back(text):
                all_turns.update(f"{role}\n{own}\n".encode())
                n += 1
            # Pieces that touch are joined first, so that no escape is cut in two.
            if len(pieces):
                new = np.concatenate([[True], pieces[1:, 0] != pieces[:-1, 1]])
                for a, b in zip(pieces[new, 0], pieces[np.concatenate([new[1:], [True]]), 1]):
                    own = unescape(text[a:b])
                    all_loss.update(own.encode())
                    loss += len(own)
            chars += len(text)
            if last:
                for column, v in zip(done, (conv, n, all_turns.hexdigest(), loss, all_loss.hexdigest(), chars)):
                    column.append(v)
                n = chars = loss = 0
                all_turns, all_loss = hashlib.sha256(), hashlib.sha256()
                if len(done[0]) >= 2000:
                    yield flush()
                    done = [[] for _ in names]
        if done[0]:
            yield flush()

    return _by_conversation(rows).mapInArrow(
        run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
