"""A layered proximity graph for one segment, in numpy, and its build and search over all segments.

The graph is kept in arrays: one neighbour matrix for each layer. Rows enter layer by layer from the
top in bulk order; each takes its nearest m of a beam search, and full rows keep their nearest.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..errors import InvalidArgument
from ..shipping import ship


@dataclass(frozen=True)
class GraphSettings:
    """Default width, beams and seed."""

    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    seed: int = 42

    def __post_init__(self) -> None:
        if self.m < 2:
            raise InvalidArgument("m must be at least 2")


@dataclass
class Graph:
    """ids and vectors by node, top layer of each node, neighbours by (layer, node), and the entry node (-1: empty)."""

    metric: str
    settings: GraphSettings = field(default_factory=GraphSettings)
    ids: list[int] = field(default_factory=list)
    vectors: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    top: list[int] = field(default_factory=list)
    near: dict[tuple[int, int], list[int]] = field(default_factory=dict)
    entry: int = -1
    gone: set[int] = field(default_factory=set)

    def distances(self, query: np.ndarray, nodes: Sequence[int]) -> np.ndarray:
        x = self.vectors[list(nodes)]
        if self.metric == "l2":
            d = x - query
            return (d * d).sum(axis=1)
        return -(x @ query)

    def _ready(self, vector: Sequence[float]) -> np.ndarray:
        x = np.asarray(vector, float)
        n = math.sqrt(float(x @ x))
        return x / n if self.metric == "cosine" and n else x

    def _all_ready(self, vectors: Sequence[Sequence[float]]) -> np.ndarray:
        x = np.array(vectors, float)
        n = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return x / np.where(n > 0, n, 1) if self.metric == "cosine" else x

    @classmethod
    def build(cls, ids: Sequence[int], vectors: Sequence[Sequence[float]], metric: str, settings: GraphSettings = GraphSettings()) -> Graph:
        g = cls(metric, settings)
        g.vectors = g._all_ready(vectors) if len(ids) else np.empty((0, 0))
        levels = np.floor(-np.log(1 - np.random.default_rng(settings.seed).random(len(ids))) / math.log(settings.m)).astype(int)
        for i, (node_id, level) in enumerate(zip(ids, levels.tolist())):
            g.ids.append(int(node_id))
            g.top.append(level)
            g._link(i)
        return g

    def _link(self, i: int) -> None:
        level, query = self.top[i], self.vectors[i]
        if self.entry < 0:
            self.entry = i
            return
        at = self._descend(query, self.entry, self.top[self.entry], level)
        for layer in range(min(level, self.top[self.entry]), -1, -1):
            found = self.beam(query, [at], layer, self.settings.ef_construction)
            chosen = [n for _, n in found[: self.settings.m]]
            self.near[layer, i] = chosen
            room = self.settings.m * (1 if layer else 2)
            for n in chosen:
                back = self.near.setdefault((layer, n), [])
                back.append(i)
                if len(back) > room:
                    d = self.distances(self.vectors[n], back)
                    self.near[layer, n] = [back[j] for j in np.lexsort((back, d))[:room]]
            at = found[0][1]
        if level > self.top[self.entry]:
            self.entry = i

    def _descend(self, query: np.ndarray, at: int, start: int, stop: int) -> int:
        """Nearest node met on the way down from layer start to the one above stop."""
        for layer in range(start, stop, -1):
            at = self.beam(query, [at], layer, 1)[0][1]
        return at

    def beam(self, query: np.ndarray, starts: Sequence[int], layer: int, width: int) -> list[tuple[float, int]]:
        """Up to `width` nearest (distance, node) of a layer, reached from starts."""
        seen = set(starts)
        kept = [(-float(d), n) for d, n in zip(self.distances(query, starts), starts)]
        heapq.heapify(kept)
        todo = [(-d, n) for d, n in kept]
        heapq.heapify(todo)
        while todo:
            d, n = heapq.heappop(todo)
            if len(kept) >= width and d > -kept[0][0]:
                break
            fresh = [x for x in self.near.get((layer, n), ()) if x not in seen]
            seen.update(fresh)
            for e, x in zip(self.distances(query, fresh).tolist() if fresh else (), fresh):
                if len(kept) < width or e < -kept[0][0]:
                    heapq.heappush(todo, (e, x))
                    (heapq.heappush if len(kept) < width else heapq.heapreplace)(kept, (-e, x))
        return sorted((-d, n) for d, n in kept)

    def search(self, vector: Sequence[float], k: int, ef: int = 0) -> list[tuple[int, float]]:
        """Up to k (id, distance), nearest first; removed ids are left out."""
        return [(self.ids[n], d) for d, n in self.nodes(vector, k, ef)]

    def nodes(self, vector: Sequence[float], k: int, ef: int = 0) -> list[tuple[float, int]]:
        """Up to k (distance, node), nearest first."""
        if self.entry < 0:
            return []
        query = self._ready(vector)
        at = self._descend(query, self.entry, self.top[self.entry], 0)
        found = self.beam(query, [at], 0, max(k + len(self.gone), ef or self.settings.ef_search))
        return [(d, n) for d, n in found if self.ids[n] not in self.gone][:k]

    def remove(self, node_id: int) -> bool:
        """The node stays a stepping stone, but isn't found any more, and another one of the highest layer left becomes the entry."""
        known = node_id in self.ids and node_id not in self.gone
        if known:
            self.gone.add(node_id)
            left = [(-t, i) for i, t in enumerate(self.top) if self.ids[i] not in self.gone]
            if left and self.ids[self.entry] in self.gone:
                self.entry = min(left)[1]
        return known

    def packed(self) -> dict:
        """The graph as one row: arrays as bytes, neighbours layer by layer for each node."""
        lists = [self.near.get((layer, i), ()) for i, top in enumerate(self.top) for layer in range(top + 1)]
        flat = np.concatenate([np.asarray(x, np.int32) for x in lists]) if lists else np.empty(0, np.int32)
        return {
            "n": len(self.ids), "entry": self.entry, "seqs": np.array(self.ids, np.int64).tobytes(), "vectors": np.ascontiguousarray(self.vectors, np.float32).tobytes(), "tops": np.array(self.top, np.int32).tobytes(),
            "sizes": np.array([len(x) for x in lists], np.int32).tobytes(), "near": flat.tobytes(), "gone": np.array(sorted(self.gone), np.int64).tobytes(),
        }

    @classmethod
    def unpacked(cls, row: dict, metric: str, settings: GraphSettings = GraphSettings()) -> Graph:
        g = cls(metric, settings)
        g.ids, g.top = np.frombuffer(row["seqs"], np.int64).tolist(), np.frombuffer(row["tops"], np.int32).tolist()
        g.vectors = g._all_ready(np.frombuffer(row["vectors"], np.float32).reshape(len(g.ids), -1)) if g.ids else np.empty((0, 0))
        g.near = _Near(g.top, np.frombuffer(row["sizes"], np.int32), np.frombuffer(row["near"], np.int32))
        g.entry, g.gone = row["entry"], set(np.frombuffer(row["gone"], np.int64).tolist())
        return g


class _Near(dict):
    """Neighbours by (layer, node), read from packed arrays when asked for."""

    def __init__(self, top: list[int], sizes: np.ndarray, flat: np.ndarray) -> None:
        super().__init__()
        self.first = np.r_[0, np.cumsum(np.array(top, np.int64) + 1)] if top else np.zeros(1, np.int64)
        self.ends, self.flat, self.top = np.r_[0, np.cumsum(sizes)], flat, top

    def get(self, key: tuple[int, int], default: Sequence[int] = ()) -> Sequence[int]:
        layer, node = key
        if key in self or layer > self.top[node]:
            return super().get(key, default)
        i = self.first[node] + layer
        found = self[key] = self.flat[self.ends[i] : self.ends[i + 1]].tolist()
        return found


SIDECAR = "segment_id long, n long, entry int, seqs binary, keys array<string>, vectors binary, tops binary, sizes binary, near binary, gone binary"


def build_graphs(rows: DataFrame, metric: str, settings: GraphSettings = GraphSettings(), least: int = 512) -> DataFrame:
    """One row for each segment, with its rows' seq, key and vector, and, from `least` rows on, a graph of them.

    Rows are (segment_id, seq, key, embedding); a segment is bounded by the caller and built in one task.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        seqs, n = table["seq"].to_pylist(), table.num_rows
        vectors = np.array(table["embedding"].to_pylist(), np.float32)
        if n < least:
            made = Graph(metric, settings, seqs, vectors, [0] * n).packed()  # entry -1: all rows are compared
        else:
            made = Graph.build(seqs, vectors, metric, settings).packed() | {"vectors": vectors.tobytes()}
        kinds = {"n": pa.int64(), "entry": pa.int32()}
        cols = {c: pa.array([v], kinds.get(c, pa.binary())) for c, v in made.items()}
        cols |= {"segment_id": table["segment_id"].slice(0, 1), "keys": pa.array([table["key"].to_pylist()], pa.list_(pa.string()))}
        return pa.table({f.split()[0]: cols[f.split()[0]] for f in SIDECAR.split(", ")})

    ship(rows.sparkSession)
    return rows.select("segment_id", "seq", "key", "embedding").groupBy("segment_id").applyInArrow(run, SIDECAR)


def search_graphs(sidecar: DataFrame, query: Sequence[float], k: int, metric: str, settings: GraphSettings = GraphSettings(), ef: int = 0) -> DataFrame:
    """Candidates (seq, key, embedding, distance) of every segment: twice k, and 32 at least, for exact ranking. Segments are read where they lie: no shuffle."""
    most = max(2 * k, 32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                row = {name: whole.column(name)[i].as_py() for name in whole.schema.names if name not in ("keys", "segment_id")}
                g = Graph.unpacked(row, metric, settings)
                if g.entry >= 0:
                    found = g.nodes(query, most, max(ef, most))
                else:
                    d = g.distances(g._ready(query), range(len(g.ids))) if g.ids else np.empty(0)
                    found = [(float(d[j]), int(j)) for j in np.lexsort((np.arange(len(d)), d))[:most]]
                raw, keys = np.frombuffer(row["vectors"], np.float32).reshape(len(g.ids), -1), whole.column("keys")[i]
                yield pa.RecordBatch.from_arrays([
                    pa.array([g.ids[j] for _, j in found], pa.int64()), pa.array([keys[j].as_py() for _, j in found], pa.string()),
                    pa.array([raw[j] for _, j in found], pa.list_(pa.float32())), pa.array([d for d, _ in found], pa.float64()),
                ], names=["seq", "key", "embedding", "distance"])

    ship(sidecar.sparkSession)
    return sidecar.mapInArrow(run, "seq long, key string, embedding array<float>, distance double")
