"""Chat formatting with an offset-aligned loss mask.

A conversation is rendered once, as a whole: each turn is `<|turn|>role`, a line feed, its text and
`<|end|>` with a line feed. Control strings inside roles and texts are escaped: a backslash is
doubled, `<|` becomes `<\\|`, and a line feed in a role becomes `\\n`; so no marker occurs inside a
turn, and undoing is exact. The rendered text is encoded once, with offsets; the markers are single
added tokens, so that no token crosses a turn's edge. A binary search of the sorted token spans
against the sorted spans of the assistant's texts gives the loss mask.

Defined results: turns are ordered by turn, role and text, nulls first, and repeated rows are
repeated turns; a null text or role is empty; rows with a null conversation id form one
conversation; an empty table gives an empty result; other columns are ignored. A conversation is
one unit of rendering and encoding and is held in memory as a whole.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, tidied, tokenizer_path

TURN, END = "<|turn|>", "<|end|>"


def escape(text: str | None, role: bool = False) -> str:
    out = (text or "").replace("\\", "\\\\").replace("<|", "<\\|")
    return out.replace("\n", "\\n") if role else out


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.DOTALL)


def render(turns: list[tuple[str | None, str | None]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the span of each turn's escaped text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role, True)}\n", escape(text)
        parts += [head, body, END, "\n"]
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns, read back from the formatted text alone."""
    out = []
    for part in formatted.split(TURN)[1:]:
        role, _, rest = part.partition("\n")
        out.append((unescape(role), unescape(rest[: rest.index(END)])))
    return out


@lru_cache(maxsize=4)
def chat_tokenizer(path: str | None = None):
    """The byte-level tokenizer with the markers as added tokens and untrimmed offsets."""
    from tokenizers import AddedToken, Tokenizer
    from tokenizers.processors import ByteLevel

    t = Tokenizer.from_file(path or tokenizer_path("byte_bpe_50k.json"))
    t.post_processor = ByteLevel(trim_offsets=False)
    t.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, END)])
    return t


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """True for each token within one of the sorted, disjoint spans; tokens that cross an edge are refused."""
    out = np.zeros(len(starts), bool)
    if not spans or not len(starts):
        return out
    s = np.array(spans, np.int64)
    at = np.searchsorted(s[:, 0], starts, side="right") - 1
    inside = (at >= 0) & (starts < s[at, 1])
    if (inside & (ends > s[at, 1])).any():
        raise ValueError("a token crosses the edge of a turn")
    return inside


def covered(formatted: str, starts: np.ndarray, ends: np.ndarray, on: np.ndarray) -> list[str]:
    """The stretches of formatted that the masked tokens cover; tokens of one character share it."""
    s, e = starts[on], np.maximum.accumulate(ends[on]) if on.any() else ends[on]
    new = np.flatnonzero(np.r_[True, s[1:] > e[:-1]][: len(s)])
    return [formatted[lo:hi] for lo, hi in zip(s[new].tolist(), e[np.r_[new[1:], len(s)] - 1].tolist() if len(s) else [])]


def lists_of(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """A column of lists, from an array for each row."""
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat).cast(kind))


FORMATTED = "formatted string, input_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def format_chats(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant", tokenizer_file: str | None = None) -> DataFrame:
    """One row for each conversation: the formatted text, ids, token offsets (code points) and loss mask."""
    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[id_col]
    turns = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    whole = rows.groupBy(F.col(id_col).alias("id")).agg(F.sort_array(F.collect_list(turns)).alias("turns"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = chat_tokenizer(tokenizer_file)
        for whole_batch in batches:
            for b in (whole_batch.slice(i, 64) for i in range(0, whole_batch.num_rows, 64)):
                texts, ids, starts, ends, masks = [], [], [], [], []
                for conv in b.column(1).to_pylist():
                    said = [(x["role"], x["text"]) for x in conv]
                    formatted, spans = render(said)
                    e = t.encode(formatted, add_special_tokens=False)
                    offsets = np.fromiter(itertools.chain.from_iterable(e.offsets), np.int32, 2 * len(e)).reshape(-1, 2)
                    texts.append(formatted)
                    ids.append(np.array(e.ids, np.int32))
                    starts.append(offsets[:, 0])
                    ends.append(offsets[:, 1])
                    masks.append(mask(offsets[:, 0], offsets[:, 1], [s for s, (role, _) in zip(spans, said) if role == loss_role]))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(texts, pa.string()), *(lists_of(x, pa.int32()) for x in (ids, starts, ends)), lists_of(masks, pa.bool_())],
                    names=[id_col, "formatted", "input_ids", "token_starts", "token_ends", "loss_mask"],
                )

    return whole.mapInArrow(tidied(run), f"`{id_col}` {kind}, {FORMATTED}")
