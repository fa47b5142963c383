"""N-gram Jaccard join by universe partition and pigeonhole, verified exactly.

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Two sets of sizes a and b
can reach the similarity 0.75 only if they differ in at most (a + b) / 7 elements. Sets of a size
band (powers of two) cut the hash universe into the same number of segments; if the differences
are fewer than the units of the segments asked for, one segment differs by less than its unit:

* one unit asks for an equal segment,
* two units ask for a segment that differs by one element at most (its one-deletion neighbourhood).

The larger set of a pair asks; it takes one unit from each of its cheapest segments, by the number
of documents that hold a segment's rarest shingle, and only if its segments are too few, two units
from the cheapest ones. Smaller sets are found in their own band and, in its upper half, in the
next one. A set with too few units even so meets all sets that share an element of its prefix: the
first shingles by hash, of which similar sets share one.

Signatures travel packed in blobs, one for each chunk of documents and bucket, sorted, so that a
bucket is met range by range. Equal sets count once there (they link by their digest). Each
group of equal signatures gives a star around its smallest id. Each member is verified first with
the hub it met most often, and components are formed; only then are the pairs that remain, those of
a group that are in different components, verified too, all of them. So no link between components is lost, and a group of copies never
becomes all of its pairs. Pairs that remain must share as many segments as similar sets do: pairs
that meet in small groups are counted there, others in bounded cells.

Defined results: a text without words and a null text have an empty set and link with nothing;
fewer words than five are one shingle; a null id has no component; rows that repeat an id give one
row each and share the id's component; an empty table gives an empty result; other columns are
ignored. Whole texts of any length are used.
"""

from __future__ import annotations

import itertools
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions, ship, sliced, small_or_whole, tidied, write_table
from .components import connected_components

N, ALL, TIMES = 5, 7, 3  # words in a shingle; similar sets share at least TIMES / ALL of the sum of their sizes
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())
CHUNK, BLOCK = 4096, 512  # most documents in a blob, and at a time in the kernels
SHINGLES = 1 << 19  # about as many in a chunk or a tile at most; longer documents are alone
RANGE = 1 << 18  # signatures met at a time
SMALL = 64  # sets up to this size are kept as blobs for those with too few units
UP, INDEX, PROBE = 1 << 13, 1 << 14, 1 << 15  # a signature of the next band; one that others find; one that looks for others
DELETIONS_UNDER = 64
MEMBERS = 512  # most members in a row's share of a hub
FEW = 8  # members of a group up to which its pairs are counted as they are
TILE, TILES = 256, 4096  # members of a cluster in a tile, more or less: of one of up to 1024 members, and at most
PIECE = 4096  # most members of a group in a row
ROUNDS = 2  # of verifying each member with its likeliest hub

U = np.uint64
_ODD, _MIX1, _MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


class _Words(dict):
    """Hash of each word, kept while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * _MIX1
    x = (x ^ (x >> U(27))) * _MIX2
    return x ^ (x >> U(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles of a whole text."""
    words = text.encode().translate(LOWER).split() if text else []  # bytes split at 0x20 and 0x09 to 0x0D
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(_WORDS.__getitem__, words), U, len(words))
    if len(w) < N:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes())], U)
    h = w[: len(w) - N + 1]
    for i in range(1, N):
        h = h * _ODD + w[i : len(w) - N + 1 + i]
    return np.unique(mixed(h))


def similar(a: int, b: int, shared: int) -> bool:
    return 100 * shared >= 75 * (a + b - shared)


def segments_of(band: int) -> int:
    return max(1, 3 * (1 << band) // 4)


def cut(s: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each non-empty segment of a sorted set starts, and the segment's number: equal ranges of the hash universe."""
    seg = ((s >> U(32)) * U(segments)) >> U(32)
    starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    return starts, seg[starts]


def units(s: np.ndarray) -> tuple[int, int, int]:
    """Non-empty segments of a set in its own band, those of two or more elements, and the units needed."""
    starts, _ = cut(s, segments_of(len(s).bit_length() - 1))
    sizes = np.diff(np.r_[starts, len(s)])
    return len(starts), int((sizes > 1).sum()), 2 * len(s) // ALL + 1


def signatures(sets: list[np.ndarray], heavy: np.ndarray, heavy_df: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of non-empty sets, their roles, INDEX (found by others), PROBE (looks for others) or both, and each one's set; and each set's number of segments."""
    n = np.array([len(s) for s in sets])
    band = np.array([len(s).bit_length() - 1 for s in sets])
    sigs, roles, docs, segments = [], [], [], None

    def add(sig: np.ndarray, role: np.ndarray | int, doc: np.ndarray) -> None:
        sigs.append(sig)
        roles.append(np.broadcast_to(np.asarray(role, np.uint16), sig.shape))
        docs.append(doc)

    for up in (0, 1):
        which = np.flatnonzero(2 * n >= 3 << band) if up else np.arange(len(sets))
        if not len(which):
            continue
        s, size = np.concatenate([sets[i] for i in which]), n[which]
        doc = np.repeat(which, size)
        many = np.maximum(1, 3 * (1 << (band[which] + up)) // 4).astype(U)
        seg = ((s >> U(32)) * np.repeat(many, size)) >> U(32)
        starts = np.flatnonzero(np.r_[True, (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])])
        sizes = np.diff(np.r_[starts, len(s)])
        owner, seg = doc[starts], seg[starts]
        each = mixed(s + _ODD)
        sums = np.add.reduceat(each, starts)
        tag = seg * _MIX1 + (band[owner] + up + 1).astype(U) * _MIX2
        full = mixed(sums + tag)
        role = np.full(len(full), INDEX | UP * up, np.uint16)
        if not up:
            cost = np.ones(len(full))
            if len(heavy):
                at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                cost = np.minimum.reduceat(np.where(heavy[at] == s, heavy_df[at], 1.0), starts)
            order = np.lexsort((cost, owner))
            first = np.searchsorted(owner, which)
            segments = have = np.diff(np.r_[first, len(owner)])
            need = 2 * size // ALL + 1
            rank = np.arange(len(order)) - np.repeat(first, have)  # of each segment in order, within its set
            role[order[rank < np.repeat(need, have)]] |= PROBE
            for i in np.flatnonzero(have < need):  # few and small sets
                mine = order[first[i] : first[i] + have[i]]
                able = mine[sizes[mine] > 1][: need[i] - have[i]]
                for j in able:
                    part = slice(starts[j], starts[j] + sizes[j])
                    add(mixed(sums[j] - each[part] + tag[j]), PROBE, doc[part])
                add(mixed(full[able] ^ _ODD), PROBE, owner[able])
        add(full, role, owner)
        small = (n[doc] < DELETIONS_UNDER) & (np.repeat(sizes, sizes) > 1)
        if small.any():  # found by a set that lacks one element of a segment
            less = (np.repeat(sums + tag, sizes) - each)[small]
            add(mixed(mixed(less) ^ _ODD), INDEX | UP * up, doc[small])
    return np.concatenate(sigs), np.concatenate(roles), np.concatenate(docs), segments


MEASURED = "id long, n long, set_key binary, rest boolean, segments long, small binary, shingle long, df long"


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's id, set size, digest of the set, whether its units don't suffice, and a small set itself; and shingles frequent in this task."""
    names = [x.split()[0] for x in MEASURED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
    for b in sliced(batches, rows=BLOCK):
        sets = [shingles(t) for t in b.column(1).to_pylist()]
        had = [units(s) if len(s) else (0, 0, 0) for s in sets]
        rest = [wanting(len(s), *k) for s, k in zip(sets, had)]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        small = [s.tobytes() if 0 < len(s) <= SMALL else None for s in sets]
        none = lambda kind, n=len(sets): pa.nulls(n, kind)
        cols = [b.column(0), list(map(len, sets)), keys, rest, [k[0] for k in had], small]
        yield pa.RecordBatch.from_arrays([*(pa.array(c, k) if isinstance(c, list) else c for c, k in zip(cols, kinds)), none(kinds[6]), none(kinds[7])], names=names)
        distinct = {k: s for k, s in zip(keys, sets) if k}
        if distinct:
            every = np.sort(np.concatenate(list(distinct.values())))
            starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            n = np.diff(np.r_[starts, len(every)])
            often = n >= 4
            none = lambda kind, n=int(often.sum()): pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([*(none(k) for k in kinds[:6]), pa.array(every[starts[often]].view(np.int64)), pa.array(n[often])], names=names)


def wanting(n: int, have: int, several: int, need: int) -> bool:
    """Whether a set's segments don't give the units that it needs: one each, and two of those with several elements, if their deletions are indexed."""
    return have + (min(have, several) if n < DELETIONS_UNDER else 0) < need


def planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes together, then their second ones, and so on: what sorted or small numbers have in common shrinks when it is shuffled."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(b: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)


def _packer(heavy: np.ndarray, heavy_df: np.ndarray, keys: np.ndarray):
    """Signatures of a task's distinct sets, packed by bucket and sorted: 40 bits of signature, role and place in the blob's list of sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        ids: list[int] = []
        sets: list[np.ndarray] = []
        digests: list[bytes] = []
        held = 0

        def packed() -> pa.RecordBatch:
            parts = [signatures(sets[i : i + BLOCK], heavy, heavy_df) for i in range(0, len(sets), BLOCK)]
            sig, role = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            doc = np.concatenate([p[2] + i * BLOCK for i, p in enumerate(parts)]).astype(np.uint16)
            sizes = np.array([len(x) for x in sets]) | np.concatenate([p[3] for p in parts]) << 32
            of = [np.array(ids, np.int64), sizes, np.frombuffer(b"".join(digests), U)]
            del parts
            bucket = ((sig >> U(24) & U(0xFFFFFFFF)) * U(len(keys))) >> U(32)
            order = np.argsort(bucket << U(32) | sig & U(0xFFFFFFFF))
            ends = np.searchsorted(bucket[order], np.arange(len(keys) + 1, dtype=U))
            rows: list[list] = [[] for _ in range(6)]
            for i in range(len(keys)):
                part = order[ends[i] : ends[i + 1]]
                if len(part):
                    used, place = np.unique(doc[part], return_inverse=True)
                    row = (int(keys[i]), planes(sig[part].astype(np.uint32)) + (sig[part] >> U(56)).astype(np.uint8).tobytes(), (place.astype(np.uint16) | role[part]).tobytes(), *(planes(x[used]) for x in of))
                    for to, x in zip(rows, row):
                        to.append(x)
            for x in (ids, sets, digests):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["bucket", "sigs", "places", "ids", "sizes", "digests"])

        for b in sliced(batches):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = shingles(text)
                if not len(s) or doc_id is None or (k := xxhash.xxh3_64_digest(s.tobytes())) in seen:
                    continue
                if ids and held + len(s) > SHINGLES:
                    yield packed()
                    held = 0
                seen.add(k)
                ids.append(doc_id)
                sets.append(s)
                digests.append(k)
                held += len(s)
                if len(ids) == CHUNK:
                    yield packed()
                    held = 0
        if ids:
            yield packed()

    return run


MET = "a long, b long, n long, gid long, part int, parts int, times int, ids array<long>, sizes array<long>, roles array<int>"


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a bucket's groups of equal signatures: each member's likeliest hub, and the groups, each list of ids once."""
    blobs, bucket, total = [], 0, 0
    for b in batches:
        for bucket, s, p, *of in zip(*(c.to_pylist() for c in b.columns)):
            at = np.frombuffer(p, np.uint16)
            blobs.append((from_planes(s[: 4 * len(at)], np.uint32), np.frombuffer(s, np.uint8, len(at), 4 * len(at)), at, *(from_planes(x, kind) for x, kind in zip(of, (np.int64, np.int64, U)))))
            total += len(at)
    ranges = max(1, -(-total // RANGE))
    edges = ((np.arange(ranges + 1, dtype=U) << U(32)) // U(ranges))[1:-1].astype(np.uint32)
    cuts = [np.r_[0, np.searchsorted(x[0], edges), len(x[0])] for x in blobs]
    stars, groups = [], []
    for r in range(ranges if blobs else 0):
        star, group = _range_met(blobs, [c[r : r + 2] for c in cuts])
        stars.append(star)
        groups.append(group)
    del blobs, cuts
    if not groups:
        return
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), longs, longs, ints]
    names = [x.split()[0] for x in MET.split(", ")]
    f = np.concatenate(stars, axis=1)
    if f.shape[1]:
        f = f[:, np.lexsort((f[0], f[1]))]
        first = np.flatnonzero(np.r_[True, (f[:2, 1:] != f[:2, :-1]).any(axis=0)])
        p, n_met = f[:2, first], np.add.reduceat(f[2], first)
        best = np.lexsort((p[0], -n_met, p[1]))  # a member's likeliest hub here; the groups are kept for the rest
        best = best[np.r_[True, p[1][best][1:] != p[1][best][:-1]]]
        yield pa.RecordBatch.from_arrays([pa.array(p[0][best]), pa.array(p[1][best]), pa.array(n_met[best]), *(pa.nulls(len(best), k) for k in kinds[3:])], names=names)
    count, keys, sig, flat, role = (np.concatenate([g[i] for g in groups], axis=-1) for i in range(5))
    del groups, stars
    if not len(count):
        return
    _, once, times = np.unique(np.vstack([keys, count.astype(U)]), axis=1, return_index=True, return_counts=True)
    starts = np.r_[0, np.cumsum(count)[:-1]]
    gid = mixed(sig * _ODD + U(bucket)).view(np.int64)
    # a group of more than PIECE members takes several rows
    parts = -(-count[once] // PIECE)
    which, part = np.repeat(np.arange(len(once)), parts), np.concatenate([np.arange(k) for k in parts])
    lo = starts[once][which] + part * PIECE
    size = np.minimum(count[once][which] - part * PIECE, PIECE)
    for i in range(0, len(which), 4096):
        some = slice(i, i + 4096)
        m, ends = len(which[some]), np.r_[0, np.cumsum(size[some])]
        at = np.repeat(lo[some] - ends[:-1], size[some]) + np.arange(ends[-1])
        lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)) for v in (flat[0][at], flat[1][at], role[at].astype(np.int32))]
        cols = [gid[once][which[some]], part[some].astype(np.int32), parts[which[some]].astype(np.int32), times[which[some]].astype(np.int32)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(m, k) for k in kinds[:3]), *(pa.array(c) for c in cols), *lists], names=names)


def _range_met(blobs: list[tuple], cuts: list[np.ndarray]) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """Of one range of a bucket's signatures: (hub, member, 1) by columns; and groups: sizes, two sums of hashes, signatures, members by (id, size), roles."""
    at = [x[2][lo:hi] for x, (lo, hi) in zip(blobs, cuts)]
    s = np.concatenate([x[0][lo:hi].astype(U) << U(8) | x[1][lo:hi] for x, (lo, hi) in zip(blobs, cuts)])
    order = np.argsort(s)
    twin = np.r_[False, s[order][1:] == s[order][:-1]][: len(s)]
    order = order[twin | np.r_[twin[1:], False][: len(s)]]
    s = s[order]
    role = np.concatenate([x & np.uint16(UP | INDEX | PROBE) for x in at])[order]
    doc, n, digest = (np.concatenate([x[k][a & np.uint16(UP - 1)] for x, a in zip(blobs, at)])[order] for k in (3, 4, 5))
    order = np.lexsort((doc, digest, s))
    doc, n, role, s, digest = doc[order], n[order], role[order], s[order], digest[order]
    if len(s):  # one entry for each different set, with all its roles
        first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (digest[1:] != digest[:-1])])
        doc, n, role, s = doc[first], n[first], np.bitwise_or.reduceat(role, first), s[first]
        order = np.lexsort((n, doc, s))
        doc, n, role, s = doc[order], n[order], role[order], s[order]
        twin = np.r_[False, s[1:] == s[:-1]]
        kept = twin | np.r_[twin[1:], False]
        doc, n, role, s = doc[kept], n[kept], role[kept], s[kept]
    if not len(s):
        return np.empty((3, 0), np.int64), (np.empty(0, np.int64), np.empty((2, 0), U), np.empty(0, U), np.empty((2, 0), np.int64), role)
    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
    count = np.diff(np.r_[starts, len(s)])
    probed = np.repeat(np.bitwise_or.reduceat(role, starts) & PROBE != 0, count)
    size, hub = n & 0xFFFFFFFF, np.repeat(starts, count)
    fit = (doc != doc[hub]) & near_sizes(size[hub], size) & probed & asked(role[hub], role)
    star = np.stack([doc[hub][fit], doc[fit], np.ones(int(fit.sum()), np.int64)])
    # lists of ids and roles are told apart by two sums of hashes over the group
    keys = np.stack([np.add.reduceat(mixed(doc.view(U) * _ODD + role.astype(U) + U(salt)), starts) for salt in (1, 2)])
    return star, (count, keys, s[starts], np.stack([doc, n]), role)


def near_sizes(n: np.ndarray, others: np.ndarray) -> np.ndarray:
    return 4 * np.minimum(n, others) >= 3 * np.maximum(n, others)


def asked(role: np.ndarray, roles: np.ndarray) -> np.ndarray:
    """Whether either side of a meeting looks for the other."""
    return ((role & PROBE != 0) & (roles & INDEX != 0)) | ((role & INDEX != 0) & (roles & PROBE != 0))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar, from the texts of docs (id, text).

    Members are sent to their pair's hub, the side with more pairs, in shares of at most about
    MEMBERS, each with the hub's own set in front; a task holds one hub's set at a time.
    """
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    pairs = pairs.join(degree.select(F.col("id").alias("a"), F.col("count").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("count").alias("db")), "b")
    hub = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    pairs = pairs.select(F.when(hub, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(hub, F.col("b")).otherwise(F.col("a")).alias("member"), F.ceil(F.greatest("da", "db") / MEMBERS).alias("shares"))
    pairs = pairs.withColumn("share", F.pmod(F.xxhash64("member"), F.col("shares")).cast("int")).drop("shares")
    pairs = write_table(pairs, "pairs")
    roles = pairs.select(F.col("member").alias("id"), F.struct("hub", "share", F.lit(False).alias("own")).alias("to"))
    roles = roles.unionByName(pairs.select("hub", "share").distinct().select(F.col("hub").alias("id"), F.struct("hub", "share", F.lit(True).alias("own")).alias("to")))
    # at most MEMBERS addresses in a row, so that neither a hub's shares nor a member's hubs make a row without bound
    roles = write_table(roles.groupBy("id", F.pmod(F.xxhash64("to"), F.lit(64)).alias("part")).agg(F.collect_list("to").alias("to")).drop("part"), "roles")
    wanted = docs.join(small_or_whole(roles, 64), "id").select("id", "to", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, column=2):
            rows: list[tuple] = []
            held = 0
            for doc_id, to, text in zip(*(c.to_pylist() for c in b.columns)):
                blob = shingles(text).tobytes()
                for i in range(0, len(to), 64):
                    rows += [(x["hub"], x["share"], not x["own"], doc_id, blob) for x in to[i : i + 64]]
                    held += len(blob) * len(to[i : i + 64])
                    if held > 4 << 20:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["hub", "share", "later", "id", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub_id, hubs = None, []
        for b in sliced(batches, column=4):
            a, c = [], []
            for hub, share, later, doc_id, blob in zip(*(x.to_pylist() for x in b.columns)):
                s = np.frombuffer(blob, U)
                if not later:
                    hubs = [*(hubs if (hub, share) == hub_id else []), s]
                    hub_id = (hub, share)
                    continue
                if (hub, share) == hub_id and any(similar(len(h), len(s), int(np.isin(s, h, assume_unique=True, kind="sort").sum())) for h in hubs):
                    a.append(hub)
                    c.append(doc_id)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])

    sent = wanted.mapInArrow(tidied(sets, _WORDS), "hub long, share int, later boolean, id long, blob binary")
    sent = sent.repartition(partitions(docs.sparkSession), "hub", "share").sortWithinPartitions("hub", "share", "later")
    return sent.mapInArrow(tidied(compare), "a long, b long")


def split_groups(groups: DataFrame, components: DataFrame) -> DataFrame:
    """The groups whose members are in more than one component c, of their members those that can have a partner there: gid, part,
    parts, times, m (c, id, size, role, wide). wide: segments of the member, of its band, in groups of more than FEW members.

    A set that is similar to one of another component shares all but n / 3 of its segments with it;
    so its entries go if too few of its segments, of one band, are in such groups. Entries meet their
    components in a shuffle join by id; a document has no more entries than signatures, so no id is hot.
    """
    where = ["gid", "part", "parts", "times"]

    def grouped(entries: DataFrame, *fields: str) -> DataFrame:
        """Groups of one component go, unless they take several rows, whose components may differ between them."""
        packed = entries.groupBy(*where).agg(F.collect_list(F.struct("c", "id", "size", "role", *fields)).alias("m"), F.min("c").alias("lo"), F.max("c").alias("hi"))
        return packed.where("parts > 1 or lo <> hi").select(*where, "m")

    entries = groups.select(*where, F.explode(F.arrays_zip("ids", "sizes", "roles")).alias("m")).select(*where, F.col("m.ids").alias("id"), F.col("m.sizes").alias("size"), F.col("m.roles").alias("role"))
    joined = entries.join(components.select(F.col("node").alias("id"), F.col("component_id").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))
    parted = write_table(grouped(joined), "split")
    entries = parted.withColumn("few", few()).select(*where, "few", F.explode("m").alias("m")).select(*where, "few", "m.*")
    by_band = Window.partitionBy("id", F.col("role").bitwiseAND(UP))
    most = F.max("size").over(by_band)
    able = entries.withColumn("able", F.sum("times").over(by_band) >= least_shared(most)).withColumn("wide", F.coalesce(F.sum(F.when(~F.col("few"), F.col("times"))).over(by_band), F.lit(0)))
    return grouped(able.where("able"), "wide")


def few() -> Column:
    return (F.col("parts") == 1) & (F.size("m") <= FEW)


def least_shared(packed: Column) -> Column:
    """Fewest segments that a set shares with a similar one, whatever that one's size; packed: its size, and above it the number of its segments."""
    return F.shiftright(packed, 32) - F.floor(packed.bitwiseAND(F.lit(0xFFFFFFFF)) / 3)


def passing(a: np.ndarray, b: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Whether sets of packed sizes a and b can be similar if they share so many segments: two sets that differ in d elements differ in d segments at most."""
    n, k, m, j = a & 0xFFFFFFFF, a >> 32, b & 0xFFFFFFFF, b >> 32
    least = np.minimum(np.where(n >= m, k, j), np.where(m >= n, j, k)) - (n + m) // ALL
    return near_sizes(n, m) & (shared >= least)


def met_in_few(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that meet in a group of at most FEW members, if the segments that they share there, and
    all that either has in larger groups, are enough.

    Whether they look for each other doesn't matter here: the segment that one asks for may be in a larger group.
    A group gives FEW * (FEW - 1) / 2 pairs at most.
    """
    names = ["a", "b", "size_a", "size_b", "wide", "times"]

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 2048) for whole in batches for i in range(0, whole.num_rows, 2048)):
            m, times = b.column(1), b.column(0).to_numpy()
            starts, size = np.r_[0, np.cumsum([len(x) for x in m])], np.array([len(x) for x in m])
            c, ids, sizes, wide = (m.flatten().field(x).to_numpy(zero_copy_only=False) for x in ("c", "id", "size", "wide"))
            for n in np.unique(size):
                i, j = np.triu_indices(n, 1)
                row = np.flatnonzero(size == n)
                x, y = ((starts[row][:, None] + k).ravel() for k in (i, j))
                of = np.repeat(times[row], len(i))
                ok = c[x] != c[y]
                x, y, of = x[ok], y[ok], of[ok]
                swap = ids[x] > ids[y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                cols = [ids[x], ids[y], sizes[x], sizes[y], np.minimum(wide[x], wide[y]), of.astype(np.int64)]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols], names=names)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            ok = pa.array(passing(v[2], v[3], v[4] + v[5]))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], names=["a", "b"])

    pairs = groups.where(few()).select("times", "m").mapInArrow(tidied(met), "a long, b long, size_a long, size_b long, wide long, times long")
    pairs = pairs.groupBy("a", "b").agg(F.max("size_a").alias("size_a"), F.max("size_b").alias("size_b"), F.max("wide").alias("wide"), F.sum("times").alias("times"))
    return pairs.mapInArrow(tidied(judged), "a long, b long")


def met_in_many(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Links between different components that meet in groups of more than FEW members, of members that have enough segments in such groups.

    Groups that share members, directly or over other groups, form a cluster, and a cluster is cut into tiles. A member is one row,
    with its groups and a sketch of its set, dealt to a cell for each tile of its cluster; a cell counts the segments that the
    members of one tile share with those of the other. Pairs that share too few go, and so do those whose sketches differ too
    often. Only the sets of pairs that are left are sent, once a cell.
    """
    spark = docs.sparkSession
    wide = F.filter("m", lambda x: x["wide"] >= least_shared(x["size"]))
    groups = groups.where(~few()).withColumn("m", wide).where("size(m) > 1 or (parts > 1 and size(m) > 0)")
    groups = write_table(groups.withColumn("a", F.array_min("m.id")), "many")
    if not groups.limit(1).count():
        return spark.createDataFrame([], "a long, b long")
    # the least id is a column of the stored table, so that it isn't found again for each member
    edges = groups.select("a", F.explode("m.id").alias("b"))
    edges = edges.unionByName(groups.where("parts > 1").groupBy("gid").agg(F.min("a").alias("least"), F.collect_set("a").alias("b")).select(F.col("least").alias("a"), F.explode("b").alias("b")))
    clusters = write_table(connected_components(edges, node="id", component="cluster"), "clusters")
    sketches = docs.join(small_or_whole(clusters.select("id"), 16), "id", "left_semi").mapInArrow(tidied(_sketch, _WORDS), "id long, sketch binary")
    sketches = write_table(sketches.groupBy("id").agg(F.max("sketch").alias("sketch")), "sketches")
    met = F.col("gid").bitwiseAND(F.lit(-1 << 32)).bitwiseOR(F.col("times").cast("long"))
    members = groups.select(met.alias("met"), F.explode("m").alias("m")).groupBy(F.col("m.id").alias("id")).agg(F.max("m.c").alias("c"), F.max("m.size").alias("size"), F.collect_list("met").alias("met"))
    members = members.join(clusters, "id").join(sketches, "id")
    members = write_table(members, "members")
    elements = F.sum(F.col("size").bitwiseAND(F.lit(0xFFFFFFFF)))
    count = F.count("*")
    tiles = members.groupBy("cluster").agg(F.greatest(F.ceil(count / F.greatest(F.lit(TILE), F.least(F.lit(TILES), TILE / 32 * F.sqrt(count)))), F.ceil(elements / (2 * SHINGLES))).alias("tiles"))
    placed = members.join(small_or_whole(write_table(tiles, "tiles"), 16), "cluster").withColumn("tile", F.pmod(F.xxhash64("id"), "tiles"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    cell = F.concat_ws(":", "cluster", F.least("tile", "other"), F.greatest("tile", "other"))
    side = F.signum(F.col("tile") - F.col("other")).cast("int")
    dealt = placed.select(cell.alias("cell"), side.alias("side"), "id", "c", "size", "met", "sketch")
    dealt = dealt.repartition(partitions(spark), "cell").sortWithinPartitions("cell")

    def count_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts = None, []

        def done() -> Iterator[pa.RecordBatch]:
            for a, b in in_cell(parts):
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(a), pa.string()), pa.array(a), pa.array(b)], names=["cell", "a", "b"])

        for b in sliced(batches, column=6, rows=256):
            names = b.column(0).to_pylist()
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for lo, hi in zip(cuts, cuts[1:]):
                if names[lo] != at:
                    yield from done()
                    at, parts = names[lo], []
                some = b.slice(lo, hi - lo)
                lists = some.column(5)
                parts.append((*(some.column(i).to_numpy() for i in range(1, 5)), pc.list_value_length(lists).to_numpy(), lists.flatten().to_numpy(), some.column(6).to_pylist()))
        yield from done()

    pairs = write_table(dealt.mapInArrow(tidied(count_shared), "cell string, a long, b long"), "passing")
    cells = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().groupBy("id", F.pmod(F.xxhash64("cell"), F.lit(64)).alias("part")).agg(F.collect_list("cell").alias("cells"))
    wanted = docs.join(small_or_whole(write_table(cells.drop("part"), "cells"), 64), "id").select("id", "cells", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, column=2):
            for doc_id, to, text in zip(*(x.to_pylist() for x in b.columns)):
                blob = shingles(text).tobytes()
                at_once = max(1, (4 << 20) // max(1, len(blob)))
                for i in range(0, len(to), at_once):
                    m = len(to[i : i + at_once])
                    yield pa.RecordBatch.from_arrays([pa.array(to[i : i + at_once]), pa.array([doc_id] * m, pa.int64()), pa.nulls(m, pa.int64()), pa.array([blob] * m, pa.binary())], names=["cell", "a", "b", "blob"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, some in by_cell(batches, column=3):
            rows = [r for part in some for r in part]
            yield from linked([(r[1], np.frombuffer(r[3], U)) for r in rows if r[3] is not None], [r[1:3] for r in rows if r[3] is None])

    sent = wanted.mapInArrow(tidied(sets, _WORDS), "cell string, a long, b long, blob binary").unionByName(pairs.withColumn("blob", F.lit(None).cast("binary")))
    return sent.repartition(partitions(spark), "cell").sortWithinPartitions("cell").mapInArrow(tidied(compare), "a long, b long")


def by_cell(batches: Iterator[pa.RecordBatch], column: int | None = None, most: int = 4096) -> Iterator[tuple[str, Iterator[list[tuple]]]]:
    """Runs of rows with an equal first column, each as lists of at most `most` rows, to be used up in order."""
    cut = sliced(batches, column, 256) if column is not None else (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256))
    rows = (row for b in cut for row in zip(*(x.to_pylist() for x in b.columns)))
    for name, run in itertools.groupby(rows, key=lambda r: r[0]):
        yield name, itertools.takewhile(bool, (list(itertools.islice(run, most)) for _ in itertools.count()))


def sketch(s: np.ndarray) -> np.ndarray:
    """For each of 64 or more parts of the hash universe, 4 to 8 times as many as elements: whether it holds an odd number of them. Two sets differ in as many elements at least as parts."""
    bits = max(64, 8 << (len(s).bit_length() - 1))
    odd = np.bincount((s >> U(64 - bits.bit_length() + 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(U)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, rows=BLOCK):
        sets = [(i, s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if len(s := shingles(t))]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in sets], pa.int64()), pa.array([sketch(s).tobytes() for _, s in sets], pa.binary())], names=["id", "sketch"])


def differing(sketches: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many parts the sketches i and j differ; the longer one's parts are taken as many together as the shorter one's hold."""
    out = np.zeros(len(i), np.int64)
    width = np.array([len(x) for x in sketches])
    for wide, narrow in np.unique(np.stack([width[i], width[j]], axis=1), axis=0).tolist():
        which = np.flatnonzero((width[i] == wide) & (width[j] == narrow))
        few_words = min(wide, narrow)
        of = [np.unique(x[which], return_inverse=True) for x in (i, j)]
        rows = [np.stack([folded(sketches[k], few_words) for k in u]) for u, _ in of]
        at_once = max(1, RANGE // few_words)
        for lo in range(0, len(which), at_once):
            x, y = (r[inverse[lo : lo + at_once]] for r, (_, inverse) in zip(rows, of))
            out[which[lo : lo + at_once]] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


def folded(words: np.ndarray, n: int) -> np.ndarray:
    """A sketch of n words made of a longer one: neighbouring parts, as many as become one, are summed."""
    if len(words) == n:
        return words
    bits = np.unpackbits(words.view(np.uint8)).reshape(64 * n, -1).sum(axis=1) & 1
    return np.packbits(bits.astype(np.uint8)).view(U)


def in_cell(parts: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (a, b) of a cell's members, one of each side (0: of both), that are in different components, share segments enough and have sketches of similar sets.

    A part: sides, ids, components, packed sizes, numbers of groups, the groups (above 32 bits: the group's name) with their times (below), sketches.
    """
    if not parts:
        return
    side, ids, c, packed, many, met = (np.concatenate([p[k] for p in parts]) for k in range(6))
    sketches = [np.frombuffer(x, U) for p in parts for x in p[6]]
    starts = np.r_[0, np.cumsum(many)]
    rows, cols = np.flatnonzero(side <= 0), np.flatnonzero(side >= 0)
    both = len(rows) == len(cols) == len(ids)
    if not len(rows) or not len(cols):
        return
    spread = lambda some: (np.repeat(np.arange(len(some)), many[some]), met[np.repeat(starts[some] - np.r_[0, np.cumsum(many[some])[:-1]], many[some]) + np.arange(many[some].sum())])
    col, there = spread(cols)
    order = np.argsort(there >> 32, kind="stable")
    col, there = col[order], there[order] >> 32
    for top in range(0, len(rows), BLOCK):
        some = rows[top : top + BLOCK]
        row, here = spread(some)
        lo, hi = (np.searchsorted(there, here >> 32, x) for x in ("left", "right"))
        times, n = (here & 0xFFFFFFFF).astype(np.int32), hi - lo
        shared = np.zeros(len(some) * len(cols), np.int32)
        cut = np.r_[0, np.cumsum(n)]
        at = 0
        while at < len(n):
            end = max(at + 1, int(np.searchsorted(cut, cut[at] + RANGE, "right")) - 1)
            k = n[at:end]
            meets = col[np.repeat(lo[at:end] - (cut[at:end] - cut[at]), k) + np.arange(cut[end] - cut[at])]
            np.add.at(shared, np.repeat(row[at:end] * len(cols), k) + meets, np.repeat(times[at:end], k))
            at = end
        found = np.flatnonzero(shared)
        for lo in range(0, len(found), RANGE):
            cell = found[lo : lo + RANGE]
            i, j = some[cell // len(cols)], cols[cell % len(cols)]
            ok = (c[i] != c[j]) & passing(packed[i], packed[j], shared[cell])
            if both:
                ok &= i < j
            i, j = i[ok], j[ok]
            ok = ALL * differing(sketches, i, j) <= (packed[i] & 0xFFFFFFFF) + (packed[j] & 0xFFFFFFFF)
            i, j = i[ok], j[ok]
            if len(i):
                yield np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])


def linked(sets: list[tuple[int, np.ndarray]], pairs: list[tuple[int, int]], at_once: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Those of a cell's pairs whose sets are similar; an id may have more than one set. About at_once elements are compared at a time."""
    if not sets or not pairs:
        return
    of: dict[int, list[np.ndarray]] = {}
    for i, s in sets:
        of.setdefault(i, []).append(s)
    partners: dict[int, set[int]] = {}
    for a, b in pairs:
        partners.setdefault(a, set()).add(b)
    found: tuple[list, list] = [], []

    def compare(a: int, s: np.ndarray, others: list[tuple[int, np.ndarray]]) -> None:
        size = np.array([len(x) for _, x in others])
        picked = np.concatenate([x for _, x in others])
        at = np.minimum(np.searchsorted(s, picked), len(s) - 1)
        shared = np.add.reduceat((s[at] == picked).astype(np.int64), np.r_[0, np.cumsum(size)[:-1]])
        for k in np.flatnonzero(100 * shared >= 75 * (len(s) + size - shared)):
            found[0].append(a)
            found[1].append(others[k][0])

    for a, every in partners.items():
        for s in of.get(a, ()):
            others, held = [], 0
            for b in sorted(every):
                for x in of.get(b, ()):
                    others.append((b, x))
                    held += len(x)
                    if held >= at_once:
                        compare(a, s, others)
                        others, held = [], 0
            if others:
                compare(a, s, others)
    if found[0]:
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])


def apart(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """The pairs whose sides are in different components."""
    for side in ("a", "b"):
        pairs = pairs.join(components.select(F.col("node").alias(side), F.col("component_id").alias(f"c{side}")), side, "left")
    return pairs.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def prefix(n: int) -> int:
    """How many of a set's first elements (in one order for all) hold one of those shared with any similar set."""
    return n - (3 * n + 3) // 4 + 1


def by_prefix(docs: DataFrame, measured: DataFrame, rest: DataFrame) -> DataFrame:
    """Pairs of the sets in rest (set_key, id, n) with all sets of a fitting size that share an element of their prefixes with them.

    Equal sets count once, by their smallest id.
    """
    lo, hi = rest.agg(F.min("n"), F.max("n")).first()
    fitting = f"4 * n >= {3 * lo} and 3 * n <= {4 * hi} and id is not null"

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["set_key", "id", "n", "shingle"]
        for b in sliced(batches, column=1):
            rows = [(i, np.frombuffer(x, U)) if isinstance(x, bytes) else (i, shingles(x)) for i, x in zip(*(c.to_pylist() for c in b.columns)) if i is not None and x]
            rows = [(i, s) for i, s in rows if len(s) and 4 * len(s) >= 3 * lo and 3 * len(s) <= 4 * hi]
            if rows:
                keys, sizes = [xxhash.xxh3_128_digest(s.tobytes()) for _, s in rows], np.array([len(s) for _, s in rows])
                counts = np.array([prefix(n) for n in sizes.tolist()])
                each = np.repeat(np.arange(len(rows)), counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()).take(pa.array(each)), pa.array(np.array([i for i, _ in rows])[each]), pa.array(sizes[each]), pa.array(np.concatenate([s[:k] for (_, s), k in zip(rows, counts)]).view(np.int64))], names=names)

    # small sets were kept; only if larger ones are asked for are the texts read again
    source = measured.where(fitting).select("id", "small") if 4 * hi <= 3 * SMALL else docs
    every = source.mapInArrow(tidied(elements, _WORDS), "set_key binary, id long, n long, shingle long")
    every = write_table(every.groupBy("set_key", "n", "shingle").agg(F.min("id").alias("id")), "shingles")
    asking = every.join(small_or_whole(rest.select("set_key"), 64), "set_key", "left_semi").select(F.col("set_key").alias("x_key"), F.col("id").alias("x"), F.col("n").alias("xn"), "shingle")
    met = every.join(asking, "shingle").where("set_key <> x_key and id <> x and 4 * least(n, xn) >= 3 * greatest(n, xn)")
    return met.select(F.least("id", "x").alias("a"), F.greatest("id", "x").alias("b")).distinct()


def heavy_shingles(measured: DataFrame, most: int = 100_000) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles and their counts: only the cost of a segment, never what is found, depends on them."""
    rows = measured.where("shingle is not null").groupBy("shingle").agg(F.sum("df").alias("df")).where("df >= 16").orderBy(F.desc("df"), "shingle").limit(most).toPandas()
    shingle, df = rows["shingle"].to_numpy(np.int64).view(U), rows["df"].to_numpy(float)
    order = np.argsort(shingle)
    return shingle[order], df[order]


def bucket_keys(spark, n: int) -> np.ndarray:
    """n numbers that a hash partitioning into n parts deals to n different parts."""
    rows = spark.range(40 * n + 400).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    taken = {r["p"]: r["id"] for r in rows}
    return np.array([taken.get(i, i) for i in range(n)], np.int64)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Measured rows (id, n), and links (a, b) that join every set with all sets similar to it, directly or over other links."""
    spark = ship(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    measured = write_table(d.mapInArrow(tidied(_measure, _WORDS), MEASURED), "measured")
    rows = measured.where("shingle is null")
    known = rows.where("set_key is not null and id is not null")
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # sets with too few units, and ids that repeat, as a set's size and segments are then not the id's
    repeated = known.groupBy("id").agg(F.count("*").alias("k"), F.max("rest").alias("rest")).where("k > 1 or rest").select("id")
    rest = write_table(known.join(repeated, "id", "left_semi").groupBy("set_key", "n").agg(F.min("id").alias("id")), "rest")
    same = known.groupBy("set_key").agg(F.min("id").alias("a"), F.count("*").alias("k")).where("k > 1").drop("k")
    copies = known.join(same, "set_key").where("id <> a").select("a", F.col("id").alias("b"))

    buckets = max(partitions(spark), int(total * 0.7 / 1_500_000) + 1)
    packed = d.mapInArrow(tidied(_packer(*heavy_shingles(measured), bucket_keys(spark, buckets)), _WORDS), "bucket long, sigs binary, places binary, ids binary, sizes binary, digests binary")
    met = write_table(packed.repartition(buckets, "bucket").mapInArrow(tidied(_meet), MET), "met")
    pairs = write_table(met.where("a is not null").groupBy("a", "b").agg(F.sum("n").alias("n")), "candidates")
    links = write_table(copies, "similar")
    if rest.limit(1).count():
        links = links.unionByName(write_table(verified(d, write_table(by_prefix(d, measured, rest), "rest")), "similar"))
    found = connected_components(links)
    for _ in range(ROUNDS):
        pairs = write_table(apart(pairs, found), "candidates")
        # a hub met once or twice is hardly similar; such pairs are left to the count of all their segments
        best = pairs.where(F.col("n") >= 3).groupBy("b").agg(F.max_by("a", F.struct("n", -F.col("a"))).alias("a")).select("a", "b")
        best = write_table(best, "best")
        if not best.limit(1).count():
            break
        pairs = pairs.join(best, ["a", "b"], "left_anti")
        more = write_table(verified(d, best), "similar")
        if more.limit(1).count():
            found = connected_components(as_links(found).unionByName(more))
    groups = write_table(split_groups(met.where("ids is not null"), found), "groups")
    discard(met)
    links = as_links(found)
    for more in (verified(d, write_table(met_in_few(groups), "few")), met_in_many(d, groups)):
        links = links.unionByName(write_table(more, "similar"))
    return rows, links


def as_links(components: DataFrame) -> DataFrame:
    """Each node's link to the smallest node of its component: joins what was joined."""
    return components.where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, n_shingles (set size) and component_id (smallest id reachable by links, itself included)."""
    rows, links = jaccard_links(docs, id_col, text_col)
    found = connected_components(links).withColumnRenamed("node", "id")
    return rows.select("id", "n").join(found, "id", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, same columns, with one document (the smallest id, then the smallest hash of the text) of each group of similar ones.

    Rows that repeat an id count as documents of their own if their texts differ, and as one if not. Rows without an id stay.
    """
    repeated = write_table(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).count().where("count > 1").select("_id"), "repeated")
    if not repeated.limit(1).count():
        groups = jaccard_components(docs, id_col, text_col)
        gone = write_table(groups.where(F.col(id_col) != F.col("component_id")).select(id_col), "gone")
        return docs.join(small_or_whole(gone, 16), id_col, "left_anti").select(*docs.columns)
    # a number of its own for each text of a repeated id, in place of the id
    text_hash = F.xxhash64(F.lit(1), text_col)
    many = docs.join(small_or_whole(repeated, 16), F.col(id_col) == F.col("_id"), "left")
    nodes = many.withColumn("_node", F.when(F.col("_id").isNull(), F.col(id_col).cast("long")).otherwise(F.xxhash64(id_col, text_hash)))
    groups = jaccard_components(nodes.select("_node", text_col), "_node", text_col).distinct()
    order = nodes.select("_node", F.struct(F.col(id_col).alias("i"), text_hash.alias("h")).alias("o")).where("_node is not null").distinct()
    placed = write_table(order.join(groups, "_node"), "placed")
    first = placed.groupBy("component_id").agg(F.min_by("_node", "o").alias("first"))
    gone = write_table(placed.join(first, "component_id").where("_node <> first").select("_node"), "gone")
    kept = nodes.join(small_or_whole(gone, 16), "_node", "left_anti")
    twice = kept.where("_id is not null").groupBy("_node").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r")).select("r.*")
    return kept.where("_id is null").select(*docs.columns).unionByName(twice)
