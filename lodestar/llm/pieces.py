"""SentencePiece encoding by a prefix table, and decoding.

For each prefix of a text, the last token of the prefix's own encoding is unique. An automaton
gives the pieces that end at a position; the one whose predecessor (the last token of the prefix
before it) is compatible with it is that position's entry. Two tokens are compatible if the
merges of their joined text give those two tokens again; that is decided once a pair and kept.
Following the entries back from the end gives the ids.

A merge never crosses two neighbouring characters that no piece holds side by side. Texts are cut
there first, and units that recur are encoded once a worker (in bounded memory).

Defined results: a null text counts as empty and has no tokens; repeated rows each give their own
row; a null id stays null; an empty table gives an empty result; other columns are ignored. Whole
texts are encoded, of any length, in memory in proportion to the longest text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import ship, sliced, tidied, tokenizer_path

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
KEEP_UNITS, KEEP_PAIRS, KEEP_LENGTH = 500_000, 1_000_000, 32
ROWS = 512  # encoded at a time, so that a batch's ids aren't all held


class PieceCodec:
    """Encoder and decoder of one merge-type model with byte fallback."""

    def __init__(self, path: str) -> None:
        self.lib = p = sentencepiece.SentencePieceProcessor(model_file=path)
        self.piece = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        plain = [i for i in range(len(self.piece)) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i) or p.is_unused(i))]
        self.id = {self.piece[i]: i for i in plain}
        self.rank = {self.piece[i]: -p.get_score(i) for i in plain}  # merged in this order
        self.bytes = {int(self.piece[i][3:5], 16): i for i in range(len(self.piece)) if p.is_byte(i)}
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte fallback")
        chars = {c for x in self.id for c in x}
        if any(c not in self.id for c in chars) or any(re.search(f"[^{SPACE}]{SPACE}", x) for x in self.id):
            raise ValueError("pieces must be made of single-character pieces, with spaces only in front")
        self.side_by_side = {x[i : i + 2] for x in self.id for i in range(len(x) - 1)}
        self.pairs: dict[int, bool] = {}
        self.units: dict[str, tuple[int, ...]] = {}
        self.number = [str(i) for i in range(len(self.piece))]
        self.automaton = ahocorasick.Automaton()
        for x, i in self.id.items():
            if self.merged(x) == [x]:  # others never come out of merging
                self.automaton.add_word(x, (len(x), i))
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The pieces that merging leaves of a short text: best score first, leftmost among equals."""
        parts, rank, none = list(text), self.rank.get, float("inf")
        costs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while costs and (least := min(costs)) < none:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            del costs[i]
            if i:
                costs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(costs):
                costs[i] = rank(parts[i] + parts[i + 1], none)
        return parts

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= KEEP_PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(self.piece[a] + self.piece[b]) == [self.piece[a], self.piece[b]]
        return known

    def table(self, unit: str) -> list[int]:
        """The prefix table of a unit: at i the last token of unit[:i + 1], or -1 for a character without a piece."""
        last = [-1] * len(unit)
        pairs, compatible = self.pairs, self.compatible
        for end, (n, i) in self.automaton.iter(unit):
            if last[end] >= 0:
                continue  # a position has one entry
            at = end - n
            if at < 0 or (a := last[at]) < 0:
                last[end] = i
            elif (known := pairs.get(a << 32 | i)) or (known is None and compatible(a, i)):
                last[end] = i
        return last

    def unit_ids(self, unit: str) -> list[int]:
        last = self.table(unit)
        out: list[int] = []
        at = len(unit) - 1
        while at >= 0:
            if (i := last[at]) >= 0:
                out.append(i)
                at -= len(self.piece[i])
            else:
                out += [self.bytes[b] for b in reversed(unit[at].encode())]
                at -= 1
        out.reverse()
        return out

    def cut(self, word: str) -> list[str]:
        """word, cut wherever no piece holds both neighbours."""
        at, out = 0, []
        pairs = self.side_by_side
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in pairs:
                out.append(word[at:i])
                at = i
        out.append(word[at:])
        return out

    def looked_up(self, unit: str) -> tuple[int, ...]:
        if (known := self.units.get(unit)) is None:
            parts = (unit,) if unit[1:].isalpha() and len(unit) < KEEP_LENGTH else self.cut(unit)
            if len(parts) == 1:
                known = tuple(self.unit_ids(unit))
            else:
                known = tuple(i for x in parts for i in self.looked_up(x))
            if len(unit) <= KEEP_LENGTH:
                if len(self.units) >= KEEP_UNITS:
                    self.units.clear()
                self.units[unit] = known
        return known

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            units, more = self.units, self.looked_up
            for u in UNIT.findall(SPACE + text.replace(" ", SPACE)):
                out += units.get(u) or more(u)
        return out

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


_CODECS: dict[str, PieceCodec] = {}


def codec(path: str | None = None) -> PieceCodec:
    path = path or tokenizer_path("piece_bpe_32k.model")
    if path not in _CODECS:
        _CODECS[path] = PieceCodec(path)
    return _CODECS[path]


def encode_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None, with_ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id, the columns in keep, n_tokens, digests of the ids and of the decoded text, and (with_ids) the ids."""
    ship(docs.sparkSession)
    kinds = dict(docs.dtypes)
    names = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in sliced(batches, column=0, rows=ROWS):
            n, shas, decoded, every = [], [], [], []
            for text in b.column(0).to_pylist():
                ids = c.encode(text)
                n.append(len(ids))
                shas.append(hashlib.sha256(",".join([c.number[i] for i in ids]).encode()).hexdigest())
                decoded.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                if with_ids:
                    every.append(pa.array(ids, pa.int32()))
            cols = [*b.columns[1:], pa.array(n, pa.int64()), pa.array(shas, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                ends = [0]
                for x in every:
                    ends.append(ends[-1] + len(x))
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(every) if every else pa.array([], pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    schema = ", ".join(f"`{x}` {kinds[x]}" for x in names) + ", n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(docs[text_col].alias("__text"), *(docs[x] for x in names)).mapInArrow(tidied(run, _CODECS), schema)
