"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

A candidate is a long run of key-like characters, or the long value after a name and '=' in one, with
a sensitive word close by: in its name, before or after it. Its novelty is
what it adds, in compressed bytes per character, to a zstandard frame whose dictionary holds
identifiers and the text around the candidate: what the surroundings explain costs
little, a random string costs about its own length. Long candidates are weighed in slices that are too
short for zstandard to code by the frequency of letters, so that their length makes no difference.
The identifiers are the most frequent words of all the documents, at most `words` of 4 to 15 letters that
are no part of a candidate, and words that program text uses for names.

Zstandard needs several bytes a match, so names made of short words cost nearly their length too. They are
told by the same identifiers: a candidate is a name or a path if most of it is words, and most of the
words' letter triples occur in several identifiers; of random letters about a quarter do.

Defined results: a null text counts as empty and has no spans; an empty table gives an empty
result; repeated rows each give their own row; a null id stays null; other columns are ignored.
Whole texts are scanned, of any length; spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, sliced, tidied

KINDS = ("assign", "access", "hex", "novel")

# The patterns and least lengths that the contract states. Hex and access runs are
# maximal where they start, so a least count says the same as "match, then drop the short ones".
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_MIN = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 18
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")

LEAST = 16  # characters of a candidate
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{16,}")
NAMES = re.compile(r"(?:[A-Za-z_][A-Za-z0-9_.-]*=+)+(?=[^=]{16,}=*$)")
SENSITIVE = re.compile(r"(?ai:auth|bearer|cert|cookie|cred|key|login|pass|private|pwd|secret|session|sign|token)")

#: Words that program text and paths use for names; candidates built from them are cheap to compress.
IDENTIFIERS = (
    "access account action address admin api app application args array authentication authorization available back background bin block body buffer build "
    "bytes cache callback certificate change channel character check checkpoint class client code column com command common component config configuration "
    "connect connection container content context control controller cookie copy core count counter create credential current data database dataframe date "
    "debug default definition delete description dev dict dir directory dist document domain download driver element email encoding engine entry environment "
    "error event exception execute export expression factory field file filter find format from function generate get global group handler hash header home "
    "host html http https identifier image implementation import index information init initialize input instance interface internal item iterator java job "
    "json key label length lib library limit line link list listener load local location log login main manager map max message metadata method mod mode "
    "model module name net network node number object offset open operation option order org output override package packages param parameter parent parse "
    "part partition password path permission pkg point pointer port position prefix private process project property protocol provider proxy public python "
    "query range read record reference register remote render report repository request reset resource response result return root run save schedule schema "
    "scope script search section secret security select send sequence serialize server service session set shared sign signature site size socket sort "
    "source spec split sql src start state statement static status storage store stream string structure style sum sync system table tag target task temp "
    "template test text thread time timestamp tmp token transaction transform tree type unit update upload url user username usr util utility valid "
    "validate value var variable vector version view wait web width window with word work write xml yaml zone"
)
SYMBOLS = "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 https://www. .com/ get_ set_ is_ to_ "
LETTERS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Zstandard codes 64 literals or more by frequency; a slice stays below. Earlier slices are context as far back as EARLIER.
SLICE = 60
EARLIER = 4096


def triples_of(word: str) -> list[str]:
    return [word[i : i + 3] for i in range(len(word) - 2)]


@dataclass(frozen=True, eq=False)
class Identifiers:
    """The zstandard dictionary made of identifiers, and their letter triples: those of the fixed ones, and those that three of all have at least."""

    primed: bytes
    triples: frozenset[str]

    @classmethod
    def of(cls, words: Iterable[str] = ()) -> Identifiers:
        """words, the most frequent first, before the fixed ones."""
        fixed, every = IDENTIFIERS.split(), [*reversed(list(words)), *IDENTIFIERS.split()]
        seen = Counter(t for w in set(map(str.lower, every)) for t in set(triples_of(w)))
        text = " ".join(every) + " " + IDENTIFIERS.title() + " " + SYMBOLS
        return cls(text.encode(), frozenset(t for t, n in seen.items() if n >= 3) | {t for w in fixed for t in triples_of(w)})


FIXED = Identifiers.of()


def fit_identifiers(docs: DataFrame, text_col: str = "text", words: int = 4096) -> Identifiers:
    """Identifiers of the `words` most frequent words of 4 to 15 letters (A-Z, a-z) in all documents.

    A word is a whole run of key-like characters, so that no part of a candidate counts, however often it is copied.
    """
    runs = docs.select(F.explode(F.split(F.coalesce(text_col, F.lit("")), "[^A-Za-z0-9+/_=.-]+")).alias("run"))
    each = runs.select(F.rtrim("run", F.lit(".")).alias("word")).where("length(word) between 4 and 15").where(~F.col("word").rlike("[^A-Za-z]"))
    top = each.groupBy("word").count().orderBy(F.desc("count"), "word").limit(words).collect()
    return Identifiers.of(r["word"] for r in top)


def added(part: str, around: str, known: Identifiers = FIXED) -> int:
    """Marginal compressed bytes of part, given identifiers and the text around it."""
    primed = zstandard.ZstdCompressionDict(known.primed + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)
    return len(press.compress(part.encode())) - len(press.compress(b""))


@lru_cache(maxsize=4096)
def novelty(candidate: str, around: str, known: Identifiers = FIXED) -> float:
    """Marginal compressed bytes per byte of candidate, slice by slice."""
    n = len(candidate)
    cuts = [n * i // -(-n // SLICE) for i in range(-(-n // SLICE) + 1)]
    return sum(added(candidate[a:b], around + candidate[max(0, a - EARLIER) : a], known) for a, b in zip(cuts, cuts[1:])) / n


def worded(candidate: str, known: Identifiers = FIXED, share: float = 0.6) -> bool:
    """Whether a candidate is a name or a path: words make up most of it, and most of their letter triples are known."""
    parts = [w.lower() for w in LETTERS.findall(candidate) if len(w) >= 3]
    triples = [t for w in parts for t in triples_of(w)]
    marks = sum(not c.isalnum() for c in candidate)
    return bool(triples) and sum(map(len, parts)) + marks >= share * len(candidate) and sum(t in known.triples for t in triples) >= share * len(triples)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping for each kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_MIN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novel_spans(text: str, taken: list[tuple[int, int, int]], known: Identifiers = FIXED, context: int = 256, near: int = 48, least: float = 0.9) -> list[tuple[int, int, int]]:
    """Spans that the fixed patterns miss: nearly incompressible, no name, path or mail host, and a sensitive word near."""
    found = []
    for m in CANDIDATE.finditer(text):
        start, e = m.start(), m.start() + len(m[0].rstrip("./-"))
        named = NAMES.match(m[0])
        s = start + named.end() if named else start
        word = text[s:e]
        if len(word) < LEAST or text.startswith("@", start - 1, start) or any(a < e and s < b for a, _, b in taken):
            continue
        if not (SENSITIVE.search(text, max(0, min(start, s - near)), s) or SENSITIVE.search(text, e, e + near)) or worded(word, known):
            continue
        if novelty(word, text[max(0, s - context) : s] + " " + text[e : e + context], known) >= least:
            found.append((s, 3, e))
    return found


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """text with each span's secret replaced; of an assignment only the value goes. Overlaps are merged."""
    cuts = []
    for s, k, e in spans:
        m = ASSIGN.match(text, s, e) if k == 0 else None
        cuts.append((m.start(2) if m else s, e))
    out, at = [], 0
    for s, e in sorted(cuts):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def scan(text: str | None, known: Identifiers = FIXED) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Fixed spans, and all spans in order."""
    text = text or ""
    base = base_spans(text)
    return base, sorted(base + novel_spans(text, base, known))


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, counts by kind, digest of the fixed spans, and all spans as text."""
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    known = fit_identifiers(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [scan(t, known) for t in b.column(1).to_pylist()]
            counts = [[sum(k == i for _, k, _ in every) for _, every in rows] for i in range(4)]
            shas = [hashlib.sha256(listed(base).encode()).hexdigest() for base, _ in rows]
            texts = [listed(every) for _, every in rows]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in counts[:3]), pa.array(shas, pa.string()), pa.array(texts, pa.string()), pa.array(counts[3], pa.int64())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"],
            )

    return docs.select(id_col, text_col).mapInArrow(tidied(run), f"`{id_col}` {kind}, {FOUND}")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs, same columns, with every span found replaced in text_col and length_col brought up to date. Null texts stay null."""
    ship(docs.sparkSession)
    names = docs.columns
    at, length_at = names.index(text_col), names.index(length_col) if length_col in names else None
    known = fit_identifiers(docs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, column=at):
            texts = b.column(at).to_pylist()
            hits = {i: redact(t, every) for i, t in enumerate(texts) if t for every in [scan(t, known)[1]] if every}
            cols = list(b.columns)
            if hits:
                texts = [hits.get(i, t) for i, t in enumerate(texts)]
                cols[at] = pa.array(texts, b.column(at).type)
                if length_at is not None:
                    old = b.column(length_at)
                    cols[length_at] = pa.array([len(hits[i]) if i in hits else n for i, n in enumerate(old.to_pylist())], old.type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(tidied(run), docs.schema)
