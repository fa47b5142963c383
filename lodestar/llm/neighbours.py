"""Near-duplicate vectors by a flat graph with robust pruning and range-expanding greedy search.

1. Equal vectors of one label become one item. In random chunks of bounded size, tight balls of
   vectors (every member closer to the pivot than half the linking angle) become one item as well,
   round by round: all members of a ball link with each other, so a large group of copies shrinks
   to a few pivots and is never expanded into pairs.
2. Items are at home in regions of bounded size: clusters fitted on a bounded sample of each cell,
   refined level by level, the nearest one each. An item also visits every region whose boundary lies
   within the linking angle of it, so that all its partners are met in its home. A cell whose items
   would visit most of its clusters isn't split.
3. Regions that are larger than intended, visitors included, are searched exactly: home items meet
   all items in tiles; links are counted where they are met, and only a spanning forest is kept.
4. In each other region, overlapping cluster shards are linked by robust pruning, their adjacency lists
   are united, and every item (searched for in its home) is looked for from the
   shards' medoids and from its own node: a beam descends greedily, then every node within range is
   expanded until no new one appears.
5. Found pairs are decided exactly: by the cosine in double precision for single vectors; for balls by
   the triangle inequality, and member by member, in blocks, where that leaves it open.

audit() measures recall against all vectors, for the queries whose id is divisible by `every`.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label, link with nothing and are kept; vectors of different lengths never link; a null
id gives a null component and isn't kept; repeated rows count as vectors of their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, ship, small_or_whole, tidied, write_table
from .components import connected_components


@dataclass(frozen=True)
class Settings:
    """cosine: least cosine of a link. Chunk, region, shard and tile: most or intended rows in each. sample: rows that a cell's clusters
    are fitted on. crowd: a cell is split only if its items visit at most this share of its clusters on average."""

    cosine: float = 0.93
    chunk: int = 2048
    ball: int = 8
    rounds: int = 4
    region: int = 2048
    shard: int = 256
    sample: int = 4096
    levels: int = 6
    degree: int = 20
    alpha: float = 1.2
    beam: int = 16
    block: int = 512
    tile: int = 8192
    crowd: float = 0.25

    @property
    def angle(self) -> float:
        return math.acos(self.cosine)


def unit_rows(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """Usable rows as (id, label, unit): label text with the vector's length, and the unit vector's doubles as bytes."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(fine & F.exists("v", lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at = b.column(2).flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum([len(x) for x in b.column(2)])]
            units, labels = [], []
            for i, label in enumerate(b.column(1).to_pylist()):
                x = flat[at[i] : at[i + 1]]
                x = x / np.abs(x).max()  # so that squares neither overflow nor vanish
                units.append((x / np.sqrt(x @ x)).tobytes())
                labels.append(f"{len(x)}:{label}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(labels, pa.string()), pa.array(units, pa.binary())], names=["id", "label", "unit"])

    return v.mapInArrow(tidied(run), "id long, label string, unit binary")


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), float).reshape(len(rows), -1)


def balls(x: np.ndarray, radius: np.ndarray, size: np.ndarray, s: Settings) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, float]]]:
    """Each row's ball (or -1); and each ball's rows, pivot and radius."""
    of, made = np.full(len(x), -1), []
    near = x @ x.T >= s.cosine
    free = np.ones(len(x), bool)
    half = s.angle / 2 - 1e-7
    tried = np.zeros(len(x), bool)
    while True:
        n = (near & free).sum(axis=1)
        n[~free | tried] = 0
        c = int(n.argmax()) if len(n) else 0
        if not len(n) or n[c] < s.ball:
            return of, made
        tried[c] = True
        group = np.flatnonzero(near[c] & free)
        pivot = size[group] @ x[group]
        if not (norm := np.sqrt(pivot @ pivot)):
            continue
        pivot /= norm
        reach = np.arccos(np.clip(x @ pivot, -1, 1)) + radius
        group = np.flatnonzero(free & (reach <= half))
        if len(group) >= s.ball:
            of[group], free[group] = len(made), False
            made.append((group, pivot, float(reach[group].max()) + 1e-12))


def bundle(items: DataFrame, counts: DataFrame, s: Settings, turn: int) -> DataFrame:
    """One round: each item with the item it becomes part of; the one with that id carries the ball's pivot, radius and size."""
    chunks = F.ceil(F.col("n") / s.chunk)
    dealt = items.join(small_or_whole(counts, 64), "label").withColumn("chunk", F.pmod(F.xxhash64("item", F.lit(turn)), chunks)).drop("n")

    def run(table: pa.Table) -> pa.Table:
        ids, x = table["item"].to_numpy(), matrix(table["unit"])
        radius, size = table["radius"].to_numpy().copy(), table["size"].to_numpy().copy()
        units, to = table["unit"].to_pylist(), ids.copy()
        for group, pivot, reach in balls(x, radius, size, s)[1]:
            first = group[ids[group].argmin()]
            to[group] = ids[first]
            units[first], radius[first], size[first] = pivot.tobytes(), reach, size[group].sum()
        return pa.table({"item": ids, "label": table["label"], "unit": pa.array(units, pa.binary()), "radius": radius, "size": size, "to": to})

    return dealt.groupBy("label", "chunk").applyInArrow(run, "item long, label string, unit binary, radius double, size long, to long")


def kmeans(x: np.ndarray, k: int, steps: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centroids of k clusters by cosine."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(steps):
        to = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, to, x)
        norm = np.sqrt((sums * sums).sum(axis=1))
        c[norm > 0] = sums[norm > 0] / norm[norm > 0, None]
    return c


def two_nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    sims = x @ c.T
    first = sims.argmax(axis=1)
    sims[np.arange(len(x)), first] = -2
    return np.stack([first, sims.argmax(axis=1)], axis=1)


def visited(x: np.ndarray, slack: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which clusters may be nearest to a vector within slack (an angle) of each row: those whose half-spaces all lie as near."""
    sims, reach = x @ c.T, np.sin(np.minimum(slack, math.pi / 2))[:, None]
    out = np.ones(sims.shape, bool)
    for j in range(len(c)):
        out &= sims[:, j, None] - sims <= reach * np.sqrt(((c[j] - c) ** 2).sum(axis=1)) + 1e-9
    return out


def regions(items: DataFrame, s: Settings) -> DataFrame:
    """Items by cell, each at home in one and a visitor to all others that may be home to a partner; cells over s.region are split while that helps."""
    # a digest of the label, so that no label's cells can be named like another's
    cells = items.withColumn("cell", F.sha2(F.col("label").cast("binary"), 256)).withColumn("home", F.lit(True)).withColumn("final", F.lit(False))
    widest = items.agg(F.coalesce(F.max("radius"), F.lit(0.0))).first()[0]
    for level in range(s.levels):
        counts = cells.where("home and not final").groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > s.region)
        counts = write_table(counts, "cells")
        if not counts.limit(1).count():
            break
        side = small_or_whole(counts, 64)
        drawn = cells.where("home and not final").join(side, "cell").where(F.pmod(F.xxhash64("item", F.lit(level)), F.col("n")) < s.sample)

        def fitted(table: pa.Table) -> pa.Table:
            n, x = table["n"][0].as_py(), matrix(table["unit"])
            c = kmeans(x, min(64, max(2, -(-n // s.region) * 2)))
            fine = visited(x, s.angle + table["radius"].to_numpy() + widest, c).mean() <= s.crowd
            return pa.table({"cell": pa.array([table["cell"][0].as_py()]), "k": pa.array([len(c)], pa.int32()), "centroids": pa.array([c.tobytes()], pa.binary())}).slice(0, int(fine))

        centroids = write_table(drawn.select("cell", "unit", "radius", "n").groupBy("cell").applyInArrow(fitted, "cell string, k int, centroids binary"), "centroids")

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
                cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
                cell, home, final, index = [], [], [], []
                names, homes, blobs = (cols[n].to_pylist() for n in ("cell", "home", "centroids"))
                by_cell: dict[str, list[int]] = {}
                for i, at in enumerate(names):
                    by_cell.setdefault(at, []).append(i)
                for at, rows in by_cell.items():
                    if blobs[rows[0]] is None:
                        index += rows
                        cell += [at] * len(rows)
                        home += [homes[i] for i in rows]
                        final += [True] * len(rows)
                        continue
                    x = matrix(cols["unit"].take(pa.array(rows)))
                    c = np.frombuffer(blobs[rows[0]], float).reshape(-1, x.shape[1])
                    nearest = (x @ c.T).argmax(axis=1)
                    for i, j in zip(*np.nonzero(visited(x, s.angle + cols["radius"].to_numpy()[rows] + widest, c))):
                        index.append(rows[i])
                        cell.append(f"{at}/{j}")
                        home.append(bool(homes[rows[i]] and nearest[i] == j))
                        final.append(False)
                rows = b.take(pa.array(index, pa.int64()))
                kept = [rows.column(rows.schema.get_field_index(n)) for n in ("item", "label", "unit", "radius", "size")]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(cell, pa.string()), pa.array(home, pa.bool_()), pa.array(final, pa.bool_())], names=["item", "label", "unit", "radius", "size", "cell", "home", "final"])

        done = cells.where("final")
        split = cells.where(~F.col("final")).join(small_or_whole(centroids, 64 * 8 * 256), "cell", "left")
        old, cells = cells, write_table(done.unionByName(split.mapInArrow(tidied(assigned), "item long, label string, unit binary, radius double, size long, cell string, home boolean, final boolean")), "regions")
        discard(old)  # a level is read only to make the next one
    return cells


def pruned(sims: np.ndarray, allowed: np.ndarray, degree: int, alpha: float, pool: int = 48) -> np.ndarray:
    """For all points at once: from the nearest allowed ones on, a candidate stays unless one that stays is alpha times nearer to it than the point is. -1 fills."""
    m = len(sims)
    ranked = np.where(allowed, sims, -3.0)
    np.fill_diagonal(ranked, -4.0)
    order = np.argsort(-ranked, axis=1)[:, : min(pool, m - 1)]
    far = 1.0 - sims
    rows = np.arange(m)
    kept, n = np.full((m, degree), -1), np.zeros(m, int)
    for j in range(order.shape[1]):
        c = order[:, j]
        shadowed = (alpha * far[kept, c[:, None]] <= far[rows, c][:, None]) & (kept >= 0)
        add = (ranked[rows, c] > -3.0) & ~shadowed.any(axis=1) & (n < degree)
        kept[rows[add], n[add]] = c[add]
        n += add
    return kept


def flat_graph(x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """United adjacency lists of overlapping cluster shards (len(x) fills), and the shards' medoids."""
    n = len(x)
    k = max(1, -(-n // s.shard))
    c = kmeans(x, k)
    to = two_nearest(x, c) if len(c) > 1 else np.zeros((n, 1), int)
    lists: list[list[np.ndarray]] = [[] for _ in range(n)]
    medoids = []
    for j in range(len(c)):
        every = np.flatnonzero((to == j).any(axis=1))
        # a cluster of any size is cut into shards of bounded size, whose lists unite over the points' other shards
        for part in np.array_split(every, max(1, -(-len(every) // (4 * s.shard)))):
            if not len(part):
                continue
            medoids.append(part[(x[part] @ c[j]).argmax()])
            if len(part) == 1:
                continue
            sims = x[part] @ x[part].T
            out = pruned(sims, np.ones_like(sims, bool), s.degree, s.alpha)
            either = np.zeros(sims.shape, bool)
            rows, cols = np.nonzero(out >= 0)
            either[rows, out[rows, cols]] = True
            out = pruned(sims, either | either.T, s.degree, s.alpha)
            for p, near in zip(part, out):
                lists[p].append(part[near[near >= 0]])
    width = 2 * s.degree
    adjacent = np.full((n + 1, width), n)
    for p, near in enumerate(lists):
        near = np.unique(np.concatenate(near))[:width] if near else np.empty(0, int)
        adjacent[p, : len(near)] = near
    return adjacent, np.array(sorted(set(medoids)), int)


def range_search(x: np.ndarray, radius: np.ndarray, adjacent: np.ndarray, medoids: np.ndarray, queries: np.ndarray, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of queries: rows (query, found, cosine) of all nodes found whose ball may hold a link."""
    n = len(x)
    padded, wide = np.vstack([x, np.zeros(x.shape[1])]), np.r_[radius, 0.0]
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        m = len(q)
        seen, sim = np.zeros((m, n + 1), bool), np.full((m, n + 1), -2.0)
        seen[:, n] = True
        done = np.zeros((m, n + 1), bool)
        entry = np.argsort(-(x[q] @ x[medoids].T), axis=1)[:, :3]
        start = np.concatenate([medoids[entry], q[:, None]], axis=1)
        rows = np.arange(m)
        value = np.einsum("qd,qrd->qr", x[q], padded[start])
        seen[rows[:, None], start] = True
        sim[rows[:, None], start] = value
        beam = np.full((m, s.beam), n)
        beam[:, : start.shape[1]] = start[:, : s.beam]
        beam[:, 1:][beam[:, 1:] == beam[:, :1]] = n  # the own node may be a medoid
        # a node is within range if the two balls can hold vectors that link
        within = lambda a, b, c: np.arccos(np.clip(c, -1, 1)) <= s.angle + wide[a][:, None] + wide[b] + 1e-9
        waiting = [set() for _ in range(m)]
        for i, j in zip(*np.nonzero(within(q, start, value) & (start < n))):
            waiting[i].add(int(start[i, j]))
        live = rows
        while len(live):
            value = np.where(done[live[:, None], beam[live]] | (beam[live] == n), -3.0, sim[live[:, None], beam[live]])
            best = value.argmax(axis=1)
            node = np.where(value[np.arange(len(live)), best] > -3.0, beam[live, best], -1)
            for i in np.flatnonzero(node < 0):  # the beam is used up: the rest of what is in range
                w = waiting[live[i]]
                while w and node[i] < 0:
                    if not done[live[i], p := w.pop()]:
                        node[i] = p
            live, node = live[node >= 0], node[node >= 0]
            if not len(live):
                break
            done[live, node] = True
            near = adjacent[node]
            near = np.where(seen[live[:, None], near], n, near)
            value = np.where(near < n, np.einsum("qd,qrd->qr", x[q[live]], padded[near]), -2.0)
            seen[live[:, None], near] = True
            sim[live[:, None], near] = value
            for i, j in zip(*np.nonzero(within(q[live], near, value) & (near < n))):
                waiting[live[i]].add(int(near[i, j]))
            both = np.concatenate([beam[live], near], axis=1)
            top = np.argpartition(-sim[live[:, None], both], s.beam - 1, axis=1)[:, : s.beam]
            beam[live] = both[np.arange(len(live))[:, None], top]
        sim[:, n] = -2
        a, b = np.nonzero(seen[:, :n] & (sim[:, :n] > -2))
        c = sim[a, b]
        ok = (np.arccos(np.clip(c, -1, 1)) <= s.angle + radius[q[a]] + radius[b] + 1e-9) & (q[a] != b)
        yield q[a[ok]], b[ok], c[ok]


def found_pairs(cells: DataFrame, s: Settings) -> DataFrame:
    """Pairs of items (a < b) that link as a whole (whole), or may link in part."""

    def run(table: pa.Table) -> pa.Table:
        table = table.group_by("item").aggregate([("unit", "min"), ("radius", "min"), ("home", "max")])
        ids, x, radius = table["item"].to_numpy(), matrix(table["unit_min"]), table["radius_min"].to_numpy()
        order = np.argsort(ids)
        ids, x, radius, home = ids[order], x[order], radius[order], table["home_max"].to_numpy(zero_copy_only=False)[order]
        a, b, whole = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, bool)]
        if len(ids) > 1:
            adjacent, medoids = flat_graph(x, s)
            for p, q, c in range_search(x, radius, adjacent, medoids, np.flatnonzero(home), s):
                single = (radius[p] == 0) & (radius[q] == 0)
                exact = np.einsum("ij,ij->i", x[p], x[q]) >= s.cosine
                sure = np.where(single, exact, np.arccos(np.clip(c, -1, 1)) + radius[p] + radius[q] <= s.angle - 1e-9)
                keep = sure | ~single
                a.append(np.minimum(ids[p], ids[q])[keep])
                b.append(np.maximum(ids[p], ids[q])[keep])
                whole.append(sure[keep])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "whole": np.concatenate(whole)})

    return cells.select("cell", "item", "unit", "radius", "home").groupBy("cell").applyInArrow(run, "a long, b long, whole boolean").groupBy("a", "b").agg(F.max("whole").alias("whole"))


def spanning(near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of links: (row, linked column) and (row, row of its component) that keep what is connected connected."""
    rows, cols, tied, other = [], [], [], []
    fresh, open_cols = near.any(axis=1), np.ones(near.shape[1], bool)
    for r in np.flatnonzero(fresh):
        if not fresh[r]:
            continue
        fresh[r], frontier = False, np.array([r])
        while len(frontier):
            met = np.flatnonzero(near[frontier].any(axis=0) & open_cols)
            open_cols[met] = False
            frontier = np.flatnonzero(near[:, met].any(axis=1) & fresh)
            fresh[frontier] = False
            rows.append(np.full(len(met), r))
            cols.append(met)
            tied.append(np.full(len(frontier), r))
            other.append(frontier)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, cols, tied, other))


def met_exactly(cells: DataFrame, crowded: DataFrame, s: Settings) -> DataFrame:
    """Of crowded cells, every home item against every item: (a, null, n): n vectors link as wholes with a; (a, b, null): links
    that connect what is connected; (a, b, 0): pairs that may link in part."""
    side = crowded.select("cell", F.ceil(F.col("homes") / s.tile).alias("his"), F.ceil(F.col("n") / s.tile).alias("los"))
    rows = cells.join(side, "cell").select("cell", "item", "unit", "radius", "size", "home", "his", "los")
    part = lambda n: F.pmod(F.xxhash64("item"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    asks = rows.where("home").withColumn("i", part("his")).withColumn("j", every("los")).withColumn("asks", F.lit(True))
    told = rows.withColumn("j", part("los")).withColumn("i", every("his")).withColumn("asks", F.lit(False))
    dealt = asks.unionByName(told).select("cell", "i", "j", "item", "unit", "radius", "size", "asks")

    def run(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, x, radius, size = table["item"].to_numpy(), matrix(table["unit"]), table["radius"].to_numpy(), table["size"].to_numpy()
        p, q = np.flatnonzero(asks), np.flatnonzero(~asks)
        near = np.zeros((len(p), len(q)), bool)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for lo in range(0, len(p), 256):
            m = p[lo : lo + 256]
            c = x[m] @ x[q].T
            for i, j in zip(*np.nonzero(np.abs(c - s.cosine) < 1e-12)):
                c[i, j] = np.einsum("i,i->", x[m[i]], x[q[j]])
            sure = c >= s.cosine
            if radius[m].any() or radius[q].any():
                reach, angle = radius[m][:, None] + radius[q], np.arccos(np.clip(c, -1, 1))
                sure = np.where(reach == 0, sure, angle + reach <= s.angle - 1e-9)
                i, j = np.nonzero(~sure & (reach > 0) & (angle <= s.angle + reach + 1e-9) & (ids[m][:, None] != ids[q]))
                a.append(ids[m[i]])
                b.append(ids[q[j]])
            near[lo : lo + 256] = sure & (ids[m][:, None] != ids[q])
        total = near @ size[q]
        r, k, t, o = spanning(near)
        ties_a, ties_b = ids[p[np.r_[r, t]]], ids[np.r_[q[k], p[o]]]
        a, b, some = np.concatenate(a), np.concatenate(b), np.flatnonzero(total)
        none = lambda n: pa.nulls(n, pa.int64())
        return pa.concat_tables([
            pa.table({"a": ids[p[some]], "b": none(len(some)), "n": total[some].astype(np.int64)}),
            pa.table({"a": ties_a, "b": ties_b, "n": none(len(ties_a))}),
            pa.table({"a": a, "b": b, "n": np.zeros(len(a), np.int64)}),
        ])

    return dealt.groupBy("cell", "i", "j").applyInArrow(run, "a long, b long, n long")


def by_member(pairs: DataFrame, members: DataFrame, sizes: DataFrame, s: Settings) -> DataFrame:
    """For pairs (a, b) of balls, in both directions: each member id of a, with b and how many of b's members it links with."""
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    used = both.select(F.col("a").alias("item")).distinct().join(sizes, "item").select("item", F.ceil(F.col("size") / s.block).alias("parts"))
    rows = members.join(used, "item").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    blocks = rows.groupBy("item", "part").agg(F.collect_list(F.struct("id", "unit")).alias("m"))
    x, y = blocks.select(F.col("item").alias("a"), F.col("m").alias("x")), blocks.select(F.col("item").alias("b"), F.col("m").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, others, counts = [], [], []
            for i in range(b.num_rows):
                one, two = b.column(1)[i].as_py(), b.column(2)[i].as_py()
                left, right = (np.frombuffer(b"".join(r["unit"] for r in side), float).reshape(len(side), -1) for side in (one, two))
                n = (left @ right.T >= s.cosine).sum(axis=1)
                for j in np.flatnonzero(n):
                    ids.append(one[j]["id"])
                    others.append(b.column(0)[i].as_py())
                    counts.append(int(n[j]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(others, pa.int64()), pa.array(counts, pa.int64())], names=["id", "b", "n"])

    return both.join(x, "a").join(y, "b").select("b", "x", "y").mapInArrow(tidied(run), "id long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", settings: Settings = Settings()) -> DataFrame:
    """Each row's id, n_links (other vectors of its label within range), component_id (smallest id reachable by links) and kept."""
    s = settings
    spark = ship(vectors.sparkSession)
    units = write_table(unit_rows(vectors, id_col, vector_col, label_col), "units")
    items = write_table(units.groupBy("label", "unit").agg(F.min("id").alias("item"), F.count("*").alias("size")).withColumn("radius", F.lit(0.0)), "items")
    owners = units.join(items.select("label", "unit", "item"), ["label", "unit"]).select("id", "unit", "item")
    n, rounds = items.count(), []
    for turn in range(s.rounds):
        counts = write_table(items.groupBy("label").agg(F.count("*").alias("n")), "counts")
        turned = write_table(bundle(items, counts, s, turn), "bundled")
        rounds.append(turned)
        moved = turned.where("item <> to").select("item", "to")
        owners = owners.join(moved, "item", "left").select("id", "unit", F.coalesce("to", "item").alias("item"))
        items, before = turned.where("item = to").drop("to"), n
        n = items.count()
        if n > 0.95 * before or not counts.where(F.col("n") > s.chunk).limit(1).count():
            break
    owners = write_table(owners, "owners")
    for table in (units, *rounds[:-1]):
        discard(table)
    cells = regions(items, s)
    crowded = cells.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where((F.col("n") > 2 * s.region) & (F.col("homes") > 0))
    crowded = small_or_whole(write_table(crowded, "crowded"), 128)
    exact = write_table(met_exactly(cells, crowded, s), "exact")
    pairs = write_table(found_pairs(cells.join(crowded, "cell", "left_anti"), s), "pairs")
    counted = cells.where("home").join(crowded, "cell", "left_semi").select("item")
    sizes = items.select("item", "size")
    whole = pairs.where("whole")
    partner = whole.select(F.col("a").alias("item"), F.col("b").alias("other")).unionByName(whole.select(F.col("b").alias("item"), F.col("a").alias("other")))
    partner = partner.join(counted, "item", "left_anti")
    by_item = partner.join(sizes.withColumnRenamed("item", "other"), "other").groupBy("item").agg(F.sum("size").alias("n_whole"))
    by_item = by_item.unionByName(exact.where("b is null").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("n_whole")))
    open_pairs = exact.where("n = 0").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    open_pairs = pairs.where("not whole").select("a", "b").unionByName(open_pairs).distinct()
    part = write_table(by_member(open_pairs, owners, sizes, s), "parts")
    links = whole.select("a", "b").unionByName(exact.where("b is not null and n is null").select("a", "b")).unionByName(part.join(owners.select("id", "item"), "id").select(F.col("item").alias("a"), "b"))
    component = connected_components(links).withColumnRenamed("node", "item")
    linked = owners.select("id", "item").join(sizes, "item").join(by_item, "item", "left").join(component, "item", "left")
    linked = linked.join(part.groupBy("id").agg(F.sum("n").alias("n_part")), "id", "left")
    linked = linked.groupBy("id").agg(F.max(F.col("size") - 1 + F.coalesce("n_whole", F.lit(0)) + F.coalesce("n_part", F.lit(0))).alias("n_links"), F.min(F.coalesce("component_id", "item")).alias("component_id"))
    ids = vectors.select(F.col(id_col).cast("long").alias("id"))
    out = ids.join(linked, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))


def audit(vectors: DataFrame, result: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", every: int = 20, settings: Settings = Settings()) -> DataFrame:
    """One row: links of the query rows (ids divisible by every) by brute force in blocks, links the result has for them, and recall."""
    spark = ship(vectors.sparkSession)
    units = unit_rows(vectors, id_col, vector_col, label_col)
    blocks = max(1, partitions(spark))
    queries = units.where(F.col("id") % every == 0)
    pack = lambda rows: rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("label", "part").agg(F.collect_list(F.struct("id", "unit")).alias("m"))
    x, y = pack(queries).select("label", F.col("m").alias("x")), pack(units).select("label", F.col("m").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for one, two in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                left, right = (np.frombuffer(b"".join(r["unit"] for r in side), float).reshape(len(side), -1) for side in (one, two))
                n = (left @ right.T >= settings.cosine).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in one], pa.int64()), pa.array(n.astype(np.int64))], names=["id", "n"])

    true = x.join(y, "label").select("x", "y").mapInArrow(run, "id long, n long").groupBy("id").agg((F.sum("n") - 1).alias("true"))
    met = true.join(result.select(F.col(id_col).alias("id"), "n_links"), "id")
    return met.agg(F.coalesce(F.sum("true"), F.lit(0)).alias("links"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("found")).withColumn("recall", F.when(F.col("links") == 0, 1.0).otherwise(F.col("found") / F.col("links")))
