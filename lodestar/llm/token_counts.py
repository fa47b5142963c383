"""Token counts by section: one encoding of each whole document, attributed through offsets.

A document is encoded once with a byte-level BPE. Cumulative byte lengths give each token's byte
span, and the sections' character spans are turned into byte spans; a binary search of sorted
spans (an interval join within the document) then finds each token's section. A token that crosses
a boundary goes, by `rule`, to the section of its first byte ("start"), of its last byte ("end"),
or to the one that holds most of its bytes, the earlier one on a tie ("majority").

Sections of a text are its lines: a section ends after each line feed; the rest, if not empty, is
the last section.

Defined results: a null or empty text has no sections and no tokens (one row with n_sections 0);
repeated rows each give their own row; a null id stays null; an empty table gives an empty result;
other columns are ignored. Whole texts of any length are encoded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import ship, tokenizer_path

RULES = ("start", "end", "majority")
_ENCODERS: dict[str, tuple[object, np.ndarray]] = {}


def encoder(path: str | None = None) -> tuple[object, np.ndarray]:
    """The encoder of a ranks file, and the byte length of every token."""
    import public_tokenizers
    import tiktoken

    path = path or tokenizer_path("byte_bpe_50k.tiktoken")
    if path not in _ENCODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, rank in ranks.items():
            length[rank] = len(piece)
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), length
    return _ENCODERS[path]


def section_ends(raw: bytes) -> np.ndarray:
    """Byte offset at which each section ends."""
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(raw) else np.append(ends, len(raw)) if raw else ends


def attribute(lengths: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and for each token whether it crosses a boundary."""
    token_ends = np.cumsum(lengths)
    starts = token_ends - lengths
    first = np.searchsorted(ends, starts, side="right")
    last = np.searchsorted(ends, token_ends - 1, side="right")
    to = last if rule == "end" else first
    if rule == "majority":
        to = first.copy()
        for i in np.flatnonzero(first != last):  # rare
            edges = np.r_[starts[i], ends[first[i] : last[i]], token_ends[i]]
            to[i] = first[i] + int(np.argmax(np.diff(edges)))
    return np.bincount(to, minlength=len(ends)), first != last


COUNTED = "n_tokens long, n_sections long, n_crossing long, max_section_tokens long, section_tokens array<int>"


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rule: str = "start", ranks_path: str | None = None) -> DataFrame:
    """Each row's id, tokens in all, sections, tokens that cross a boundary, the largest section, and tokens by section."""
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, length = encoder(ranks_path)
        for b in batches:
            n, sections, crossing, most, each = [], [], [], [], []
            for text in b.column(1).to_pylist():
                raw = (text or "").encode()
                ids = enc.encode_to_numpy(text, disallowed_special=()) if text else np.empty(0, np.uint32)
                ends = section_ends(raw)
                counts, crosses = attribute(length[ids], ends, rule) if len(ids) else (np.zeros(len(ends), np.int64), np.zeros(0, bool))
                n.append(len(ids))
                sections.append(len(ends))
                crossing.append(int(crosses.sum()))
                most.append(int(counts.max()) if len(counts) else 0)
                each.append(counts.astype(np.int32))
            ends_of = np.cumsum([0, *map(len, each)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends_of), pa.array(np.concatenate(each) if each else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, sections, crossing, most)), lists], names=[id_col, "n_tokens", "n_sections", "n_crossing", "max_section_tokens", "section_tokens"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {COUNTED}")
