"""Operators that compare rows: links, passages, windows, lists; and the pipeline."""

import hashlib
import itertools
import random
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import common, contamination, jaccard, neighbours, passages, queries, url_lists

VOCAB = [f"w{i}" for i in range(3000)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def edited(rng, text, share):
    return " ".join(rng.choice(VOCAB) if rng.random() < share else w for w in text.split())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000, i) for i in range(1001, 1100)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["component_id"] for r in jaccard.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [x for x in links if None not in x and x[0] != x[1]]
    assert got == components({n for x in real for n in x}, real)
    assert jaccard.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- vectors


def brute_vectors(rows, least=0.93):
    ok = [r for r in rows if r[1] is not None and r[2] is not None and len(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    unit = [np.array(r[1], float) / np.linalg.norm(np.array(r[1], float)) for r in ok]
    n, links = {r[0]: 0 for r in rows}, []
    for i, j in itertools.combinations(range(len(ok)), 2):
        if ok[i][2] == ok[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= least:
            n[ok[i][0]] += 1
            n[ok[j][0]] += 1
            links.append((ok[i][0], ok[j][0]))
    return n, components({r[0] for r in rows}, links)


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(12):
            c = rng.normal(size=16)
            rows += [(c + rng.normal(size=16) * rng.choice([0, 0.05, 0.25, 0.4])).tolist() + [label] for _ in range(rng.choice([1, 3, 30]))]
    rows = [(i, r[:-1], r[-1]) for i, r in enumerate(rows)]
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[0][1], None), (n + 4, [], 1), (n + 5, rows[0][1][:8], 0), (n + 6, [None] * 16, 0), (n + 7, [float("inf")] + [0.0] * 15, 0)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "vec_id long, embedding array<double>, label int, n_links string").repartition(3)
    s = neighbours.Settings(chunk=64, region=60, shard=24, ball=6)
    out = neighbours.near_duplicates(df, settings=s)
    got = {r["vec_id"]: r for r in out.collect()}
    true, of = brute_vectors(rows)
    assert len(got) == len(rows) and all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    assert all(got[i]["n_links"] <= true[i] for i in true)  # a link is never made up
    assert sum(r["n_links"] for r in got.values()) >= 0.97 * sum(true.values())
    assert np.mean([got[i]["component_id"] == of[i] for i in of]) > 0.97
    assert neighbours.audit(df, out, settings=s).first()["recall"] >= 0.9
    whole = {r["vec_id"]: r for r in neighbours.near_duplicates(df).collect()}
    assert all((whole[i]["n_links"], whole[i]["component_id"]) == (true[i], of[i]) for i in true)
    assert neighbours.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("settings, n", [(neighbours.Settings(), 3500), (neighbours.Settings(chunk=64, region=60, shard=24, ball=6, tile=100), 400)])
def test_partners_are_not_capped_by_regions(spark, settings, n):
    rng = np.random.default_rng(6)
    tight = rng.normal(size=64) + rng.normal(size=(n, 64)) * 0.217  # cosine about 0.955, far from any pivot's ball
    groups = np.repeat(rng.normal(size=(40, 64)), 30, axis=0) + rng.normal(size=(1200, 64)) * 0.26
    x = np.concatenate([tight, groups, np.repeat(rng.normal(size=(3, 64)), 40, axis=0) + rng.normal(size=(120, 64)) * 0.05])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= settings.cosine
    rows = [(i, v, 1) for i, v in enumerate(x.tolist())]
    out = neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(4), settings=settings)
    got = {r["vec_id"]: r for r in out.collect()}
    true = near.sum(axis=1) - 1
    assert all(got[i]["n_links"] <= true[i] for i in got)
    assert sum(r["n_links"] for r in got.values()) >= 0.999 * true.sum()
    of, before = np.arange(len(x)), None
    while before is None or (of != before).any():
        of, before = np.where(near, of, len(x)).min(axis=1), of
    assert np.mean([got[i]["component_id"] == of[i] for i in got]) > 0.99


def test_links_stay_within_a_label(spark):
    """Labels that could be read as another label's cells."""
    rng = np.random.default_rng(8)
    base = np.repeat(rng.normal(size=(12, 8)), 20, axis=0) + rng.normal(size=(240, 8)) * 0.15
    labels = ["a", "a/0", "a/1", "8:a", "a/0/1", "", None]
    rows = [(i, base[i % 240].tolist(), labels[i // 240]) for i in range(240 * len(labels))]
    s = neighbours.Settings(chunk=64, region=64, shard=24, ball=6)
    got = {r["vec_id"]: r for r in neighbours.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string").repartition(3), settings=s).collect()}
    unit = base / np.linalg.norm(base, axis=1, keepdims=True)
    true = (unit @ unit.T >= s.cosine).sum(axis=1) - 1
    for i, _, label in rows:
        assert got[i]["n_links"] <= (0 if label is None else true[i % 240]) and (label is None or got[i]["component_id"] // 240 == i // 240)
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * (len(labels) - 1) * true.sum()


def test_recall_over_regions_with_default_settings(spark):
    """More vectors of one label than a region holds, in many groups; no link may be made up, and of 200 at most one may be missing."""
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(600, 64)), 10, axis=0) + rng.normal(size=(6000, 64)) * np.repeat(rng.choice([0.18, 0.22, 0.25], 600), 10)[:, None]
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(4)
    out = neighbours.near_duplicates(df)
    found = np.zeros(len(x), int)
    for r in out.collect():
        found[r["vec_id"]] = r["n_links"]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert (found <= true).all() and found.sum() >= 0.995 * true.sum()
    assert neighbours.audit(df, out).first()["recall"] >= 0.99


def test_spanning_links_keep_components():
    rng = np.random.default_rng(7)
    for _ in range(50):
        near = rng.random((rng.integers(1, 30), rng.integers(1, 30))) < 0.06
        m, links = len(near), [(int(i), int(j) + len(near)) for i, j in zip(*np.nonzero(near))]
        r, c, t, o = (x.tolist() for x in neighbours.spanning(near))
        nodes = range(m + near.shape[1])
        assert components(nodes, links) == components(nodes, [*zip(r, [x + m for x in c]), *zip(t, o)])


def test_balls_are_cliques():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)) * 0.1 + rng.normal(size=12)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = neighbours.Settings()
    of, made = neighbours.balls(x, np.zeros(300), np.ones(300), s)
    assert made and all((x[g] @ x[g].T >= s.cosine).all() for g, _, _ in made)


# -- shingles


def brute_sets(rows):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    links = [(rows[i][0], rows[j][0]) for i, j in itertools.combinations(range(len(rows)), 2) if rows[i][0] is not None and rows[j][0] is not None and (shared := len(sets[i] & sets[j])) and 100 * shared >= 75 * (len(sets[i]) + len(sets[j]) - shared)]
    return sets, components({r[0] for r in rows if r[0] is not None}, links)


def similar_texts(seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(14):
        t = prose(rng, rng.choice([3, 5, 6, 9, 12, 20, 40, 90, 250]))
        rows.append(t)
        for _ in range(rng.choice([0, 1, 2, 12])):
            rows.append(rng.choice([t, edited(rng, t, 0.02), edited(rng, t, 0.05), t + " " + prose(rng, 1 + len(t.split()) // 6), " ".join(t.split()[: max(1, int(len(t.split()) * 0.85))]), t.upper()]))
    line = prose(rng, 30)
    rows += [line + " " + prose(rng, 25) for _ in range(12)]
    return rows


HARD = [(901, None), (902, ""), (903, " \n"), (904, "a"), (905, "A"), (906, "a b c d"), (907, "a\x0bb\x1cc d"), (908, "word " * 4000), (909, "\u00a0x\u2003y É é"), (None, "a"), (904, "a b c d e f g")]


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_equals_brute_force(documents, seed):
    rows = list(enumerate(similar_texts(seed))) + HARD
    random.Random(seed).shuffle(rows)
    sets, of = brute_sets(rows)
    got = sorted((repr(tuple(r)) for r in jaccard.jaccard_components(documents(rows)).collect()))
    assert got == sorted(repr((i, len(s), None if i is None else of[i])) for (i, _), s in zip(rows, sets))


def test_jaccard_when_segments_are_too_few(documents, monkeypatch):
    """All sets are looked up by the elements of their prefixes then."""
    monkeypatch.setattr(jaccard, "_measure", lambda batches: (b.set_column(3, "rest", pa.array([n is not None and n > 0 for n in b.column(1).to_pylist()], pa.bool_())) for b in measure(batches)))
    rows = [r for r in enumerate(similar_texts(7)) if len(r[1].split()) < 60]
    _, of = brute_sets(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(rows)).collect()}
    assert got == of


measure = jaccard._measure


def test_signatures_meet_whenever_sets_are_similar():
    rng = np.random.default_rng(6)
    tried = 0
    for _ in range(4000):
        a = np.unique(rng.integers(0, 2**63, int(rng.choice([rng.integers(1, 12), rng.integers(1, 40), rng.integers(30, 300)])), dtype=np.uint64))
        b = np.delete(a, rng.choice(len(a), min(len(a) - 1, int(rng.integers(0, len(a) // 4 + 1))), replace=False))
        b = np.unique(np.r_[b, rng.integers(0, 2**63, int(rng.integers(0, len(a) // 4 + 1)), dtype=np.uint64)])
        if not jaccard.similar(len(a), len(b), len(np.intersect1d(a, b))):
            continue
        if any(jaccard.wanting(len(s), *jaccard.units(s)) for s in (a, b)):
            continue  # looked up by its prefix
        heavy = np.sort(a[:3])
        sig, role, of, _ = jaccard.signatures([a, b], heavy, np.full(len(heavy), 99.0))
        found = lambda i, bit: set(sig[(of == i) & (role & bit != 0)].tolist())
        assert found(0, jaccard.PROBE) & found(1, jaccard.INDEX) or found(1, jaccard.PROBE) & found(0, jaccard.INDEX)
        tried += 1
    assert tried > 1500


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * 2) for n in (1, 2, 7, 30, 100, 395, 1000)]
    sets += [np.unique(np.r_[s[rng.random(len(s)) < 0.8], rng.integers(0, 2**63, 1 + len(s) // 6, dtype=np.uint64) * 2]) for s in sets for _ in range(8)]
    i, j = np.triu_indices(len(sets), 1)
    found = jaccard.differing([jaccard.sketch(s) for s in sets], i, j)
    exact = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j)])
    assert (found <= exact).all() and ((exact - found) % 2 == 0).all()
    near = (exact < 0.4 * np.array([len(sets[a]) + len(sets[b]) for a, b in zip(i, j)])) & (exact > 20)
    assert near.sum() > 20 and found[near].sum() > 0.8 * exact[near].sum()


def test_families_of_many_tiles(documents, monkeypatch):
    """Of a family whose members share two thirds of their words, few are similar; each member is one row for each tile of its cluster."""
    monkeypatch.setattr(jaccard, "TILE", 16)
    monkeypatch.setattr(jaccard, "TILES", 16)
    rng = random.Random(8)
    line = prose(rng, 160)
    rows = [(i, line + " " + prose(rng, rng.choice([30, 45, 60]))) for i in range(150)]
    _, of = brute_sets(rows)
    made = {}
    write = jaccard.write_table

    def kept(df, label):
        made[label] = write(df, label)
        return made[label]

    monkeypatch.setattr(jaccard, "write_table", kept)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(documents(rows)).collect()}
    assert got == of
    largest = max(made["tiles"].collect(), key=lambda r: r["tiles"])
    members = made["members"].where(F.col("cluster") == largest["cluster"]).count()
    assert made["members"].count() <= len(rows) and largest["tiles"] == -(-members // 16) > 2
    assert made["passing"].count() < 150 * 149 / 2 / 4  # before sketches nearly all pairs of the family passed


def test_packed_numbers_come_back_and_shrink():
    rng = np.random.default_rng(3)
    for kind in (np.uint32, np.int64, np.uint64):
        for n in (0, 1, 5000):
            x = np.sort(rng.integers(0, np.iinfo(kind).max, n, dtype=kind, endpoint=True))
            assert (jaccard.from_planes(jaccard.planes(x), kind) == x).all() and jaccard.from_planes(jaccard.planes(x), kind).dtype == kind
    ids = rng.integers(0, 300_000, 4000)
    size = lambda b: pa.compress(b, codec="lz4_raw", asbytes=True).__len__()
    assert size(jaccard.planes(ids)) < 0.65 * size(ids.tobytes())


def test_pairs_of_a_cell_by_brute_force():
    """Both within one tile and across two."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64) * 2
    sets = [np.unique(np.r_[base[rng.random(300) < share], rng.integers(0, 2**63, int(rng.integers(1, 90)), dtype=np.uint64) * 2]) for share in rng.choice([0.7, 0.85, 0.95, 1], 60)]
    segments = []
    for s in sets:
        starts, seg = jaccard.cut(s, 192)
        segments.append((np.add.reduceat(jaccard.mixed(s), starts) ^ jaccard.mixed(seg)) >> np.uint64(33))
    packed = np.array([len(s) | len(x) << 32 for s, x in zip(sets, segments)])
    c = rng.integers(0, 20, 60)
    for across in (False, True):
        side = rng.choice([-1, 1], 60) if across else np.zeros(60, int)
        parts = []
        for k in np.array_split(np.arange(60), 3):
            met = np.concatenate([segments[i] for i in k]).astype(np.int64) << 32 | 1
            parts.append((side[k], k, c[k], packed[k], np.array([len(segments[i]) for i in k]), met, [jaccard.sketch(sets[i]).tobytes() for i in k]))
        got = {(int(x), int(y)) for a, b in jaccard.in_cell(parts) for x, y in zip(a, b)}
        asked = {(i, j) for i, j in itertools.combinations(range(60), 2) if c[i] != c[j] and (not across or side[i] != side[j])}
        similar = {(i, j) for i, j in asked if jaccard.similar(len(sets[i]), len(sets[j]), len(np.intersect1d(sets[i], sets[j])))}
        assert similar <= got <= asked and len(similar) > 50 and len(got) < len(similar) + 0.3 * (len(asked) - len(similar))


def test_shuffles_go_once_a_table_is_stored(spark):
    """What is not deleted then stays until the driver collects garbage: at 6 GB it filled the disk."""
    blocks = lambda: {x.toString() for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()) if x.toString().startswith("shuffle_")}
    before = blocks()
    setting = spark.conf.get(common.CLEANUP)
    table = common.write_table(spark.range(1000).repartition(7, "id").groupBy(F.expr("id % 50").alias("x")).count(), "counts")
    for _ in range(100):
        if not blocks() - before:
            break
        time.sleep(0.1)
    assert not blocks() - before and spark.conf.get(common.CLEANUP) == setting and table.count() == 50


def test_keep_one(documents):
    texts = similar_texts(1)
    rows = list(enumerate(texts))
    # id 3 has a text of its own as well, twice; id 500 only two texts that are similar to each other, id 501 one that is similar to 500's
    rows += [(3, "a repeated id"), (3, "a repeated id"), (500, "b " * 3 + texts[0]), (500, "c " + "b " * 3 + texts[0]), (501, "B " * 3 + texts[0]), (None, "null id"), (None, "null id")]
    docs = documents(rows)
    nodes = {(i, t): k for k, (i, t) in enumerate(sorted({(i, t) for i, t in rows if i is not None}))}
    sets, of = brute_sets([(k, t) for (_, t), k in nodes.items()])
    kept = jaccard.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    got = sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None)
    groups = {}
    for (i, t), k in nodes.items():
        groups.setdefault(of[k], []).append((i, t))
    assert len(got) == len(groups) and all(x in groups[of[nodes[x]]] and x[0] == min(groups[of[nodes[x]]])[0] for x in got)
    assert (3, "a repeated id") in got and kept.where("doc_id is null").count() == 2 and jaccard.keep_one(docs.limit(0)).count() == 0
    unique = documents(rows[: len(texts)])
    _, of = brute_sets(rows[: len(texts)])
    assert sorted(r["doc_id"] for r in jaccard.keep_one(unique).collect()) == sorted({i for i in of if of[i] == i})


# -- passages


def test_passages_are_found_and_clean_texts_left_alone(documents):
    rng = random.Random(8)
    shared, rows, spans = prose(rng, 60), {}, {}
    for i in range(40):
        rows[i] = prose(rng, rng.randrange(30, 200))
    for i in range(0, 12):
        head, body = prose(rng, rng.randrange(0, 80)), shared if i % 2 else edited(rng, shared, 0.04)
        spans[i] = (len(head.split()), len(head.split()) + 60)
        rows[i] = f"{head} {body} {prose(rng, 30)}"
    rows |= {100: None, 101: "", 102: "few words", 103: prose(rng, 200), 104: None}
    rows[105] = rows[103].upper()
    got = {}
    for r in passages.repeated_passages(documents([*rows.items(), (None, shared), (102, "few words")])).collect():
        got.setdefault(r["doc_id"], []).append((r["start_word"], r["end_word"], r["other_id"]))
        assert r["n_words"] == r["end_word"] - r["start_word"] >= 50 and r["other_id"] != r["doc_id"]
    assert set(got) == {*spans, 103, 105}
    for i, (lo, hi) in spans.items():
        assert len(got[i]) == 1 and abs(got[i][0][0] - lo) <= 6 and abs(got[i][0][1] - hi) <= 6
    assert got[105] == [(0, 200, 103)]
    assert passages.repeated_passages(documents([(1, shared)]).limit(0)).count() == 0


def test_texts_of_a_repeated_id_are_documents_of_their_own(documents):
    rng = random.Random(13)
    one, two = prose(rng, 70), prose(rng, 70)
    rows = [(1, one), (2, f"{prose(rng, 20)} {one}"), (7, f"{prose(rng, 30)} {two}"), (7, f"{one} {prose(rng, 10)}"), (7, f"{one} {prose(rng, 10)}"), (8, f"{two} {prose(rng, 40)}")]
    rows[4] = rows[3]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(documents(rows)).collect()}
    assert {(i, a) for i, a, _ in got} == {(1, 0), (2, 20), (7, 30), (7, 0), (8, 0)}


def test_fuzzy_passages_are_found(documents):
    rng = random.Random(10)
    rows = {}
    for case in range(60):
        words, every = prose(rng, 60).split(), 8 + case % 3
        changed = [f"x{case}.{i}" if i % every == every - 1 else w for i, w in enumerate(words)]
        for i, body in ((case, words), (1000 + case, changed)):
            rows[i] = f"{prose(rng, 60)} {' '.join(body)} {prose(rng, 60)}"
    got = {r["doc_id"] for r in passages.repeated_passages(documents(list(rows.items()))).collect()}
    assert got <= set(rows) and len(got) >= 0.97 * len(rows)


def test_passages_of_phrases_that_others_hold_first(documents):
    rng = random.Random(9)
    rows, want = {}, set()
    for case in range(20):
        phrases = [prose(rng, rng.choice([10, 12, 14])) for _ in range(6)]
        for i, phrase in enumerate(phrases):  # first seen in a document of its own
            rows[case * 10 + i] = f"{prose(rng, 40)} {phrase} {prose(rng, 40)}"
        for i in (1000, 2000):
            want.add(i + case)
            rows[i + case] = f"{prose(rng, 90)} {' '.join(phrases)} {prose(rng, 90)}"
    got = {r["doc_id"] for r in passages.repeated_passages(documents(list(rows.items()))).collect()}
    assert got == want


def test_frequent_seeds_are_met_within_a_chunk(documents):
    """One line in all documents, and passages that two share around it: the same passages whether the line's seeds travel or not."""
    rng = random.Random(14)
    line, rows = prose(rng, 30), {}
    for i in range(60):
        rows[i] = f"{prose(rng, 30)} {line} {prose(rng, 30)}"
    for i in range(10):
        rows[100 + i] = rows[i].replace(line, f"{line} {prose(rng, 2)}")
    docs = documents(list(rows.items()), 1)
    found = [sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in passages.repeated_passages(docs, settings=passages.Settings(often=n)).collect()) for n in (8, 10**6)]
    assert {i for i, _, _ in found[0]} == {*range(10), *range(100, 110)} and found[0] == found[1]


def test_later_holders_of_a_seed_are_paired_with_neighbours():
    keys, seed = np.arange(1, dtype=np.int64), np.uint32([7]).tobytes()
    doc, at = np.int64([1, 2, 3, 4]), np.int32([5, 6, 7, 8])
    batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([x], pa.binary()) for x in (seed * 4, np.arange(4, dtype=np.uint16).tobytes(), at.tobytes(), doc.tobytes()))], names=["bucket", *passages.SEEDS])
    (made,) = passages._stars(keys)(iter([batch]))
    d, o = (np.frombuffer(made.column(i)[0].as_py(), np.int64).tolist() for i in (1, 2))
    assert sorted(zip(d, o)) == [(1, 2), (2, 1), (2, 3), (3, 1), (3, 2), (3, 4), (4, 1), (4, 3)]


def test_many_chains_are_aligned_at_once():
    """Each as alone, and a hub's words are held once for all its members."""
    rng = np.random.default_rng(7)
    s = passages.Settings()
    pairs, expected = [], []
    for _ in range(12):
        hub = rng.integers(0, 40, int(rng.choice([30, 200, 1500])), dtype=np.uint32)
        for _ in range(6):
            member = np.where(rng.random(len(hub)) < rng.choice([0, 0.01, 0.1, 0.3]), rng.integers(0, 40, len(hub)), hub).astype(np.uint32)[: int(rng.integers(20, len(hub)))]
            chains = []
            for _ in range(8):
                x = int(rng.integers(0, len(member) - 8))
                y, n = int(rng.choice([x, rng.integers(0, len(member) - 8)])), int(rng.integers(1, 9))
                parts = [(x, y, n)] if rng.random() < 0.8 or max(x, y) + n + 4 > len(member) else [(x, y, n), (x + n + 1, y + n + 2, 2)]
                chains.append(np.array(parts, np.int32))
            pairs.append((hub, member, [c.tobytes() for c in chains]))
            for c in chains:
                x0, x1, y0, y1, same = passages.align(hub, member, c, s)
                if min(x1 - x0, y1 - y0) >= s.stretch and same >= s.identity * max(x1 - x0, y1 - y0):
                    expected.append((len(pairs) - 1, x0, x1, y0, y1, same))
    got = sorted(zip(*(v.tolist() for v in passages.align_all(pairs, s))))
    assert got == sorted(expected) and len(got) > 100
    hub = np.arange(1 << 22, dtype=np.uint32)  # 16 MB, once; 500 times would not fit
    assert len(passages.align_all([(hub, hub[:40], [np.array([[0, 0, 8]], np.int32).tobytes()])] * 500, s)[0]) == 500


def test_seeds_are_leftmost_minima():
    rng = np.random.default_rng(9)
    for n in (5, 6, 7, 8, 60):
        for pick in (1, 2, 3, 5):
            s = passages.Settings(pick=pick)
            w = rng.integers(0, 4, n, dtype=np.uint64)
            every = [passages.seeds(w[i : i + s.k], s)[0][0] for i in range(n - s.k + 1)]
            expected = sorted({i + int(np.argmin(every[i : i + pick])) for i in range(max(min(1, len(every)), len(every) - pick + 1))})
            assert passages.seeds(w, s)[1].tolist() == expected


def test_chains_are_best_by_brute_force():
    rng = random.Random(9)
    s = passages.Settings()
    for _ in range(200):
        parts = sorted({(rng.randrange(120), rng.randrange(120), rng.randrange(6, 20)) for _ in range(rng.randrange(1, 9))})

        def worth(chain):
            total = 0.0
            for a, b in zip([None, *chain], chain):
                if a:
                    dx, dy = b[0] - a[0] - a[2], b[1] - a[1] - a[2]
                    if dx < 0 or dy < 0 or max(dx, dy) > s.most_gap:
                        return None
                    total -= s.gap_cost * (dx + dy)
                total += b[2]
            return total

        found = passages.chains(list(parts), s)
        assert sorted(p for c in found for p in c) == parts and all(worth(c) is not None for c in found)
        best = max(w for n in range(1, len(parts) + 1) for c in itertools.combinations(parts, n) if (w := worth(c)) is not None)
        near = max(worth(c) for c in found)
        assert near <= best + 1e-9 and near >= best - s.gap_cost * 2 * s.most_gap


# -- contamination


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(f"_{name}", df.toPandas())
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM _{name}")
    return con.execute(sql)


@pytest.mark.parametrize("limit", [None, 0])
def test_windows_equal_the_definition(spark, documents, limit):
    rng = random.Random(10)
    items = {i: prose(rng, n) for i, n in enumerate([13, 14, 20, 40, 60, 5, 1, 12])} | {50: None, 51: "", 52: "É", 53: "x" * 9000}
    rows = {}
    for i in range(60):
        parts = [prose(rng, rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (items[rng.randrange(8)]).split()
            lo = rng.randrange(len(w))
            parts += [" ".join(w[lo : lo + rng.randrange(1, 40)]).upper(), prose(rng, rng.randrange(9))]
        rows[i] = ("; ".join(parts)).strip()
    rows |= {100: None, 101: "", 102: items[4] + " " + items[4], 103: "É é", 104: items[3].replace(" ", "\n--"), 105: "w1 " * 3000}
    rows = [*rows.items(), (102, items[4]), (102, items[4]), (102, items[4]), (100, None), (None, items[3]), (None, items[3])]
    docs = documents(rows)
    bench = spark.createDataFrame([(k, v, "extra") for k, v in items.items()], "item_id long, text string, n string")
    ours = contamination.decontaminate(docs, bench, **({} if limit is None else {"broadcast_bytes": limit}))
    expected = []
    win = {i: {tuple(w[j : j + min(13, len(w))]) for j in range(len(w) - min(13, len(w)) + 1)} for i, t in items.items() for w in [words(t)] if w}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for i, windows in win.items():
            n = len(next(iter(windows)))
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    found.add(str(i))
        expected.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    assert sorted((tuple(r) for r in ours.collect()), key=repr) == sorted(expected, key=repr)
    theirs = oracle(contamination.ORACLE, documents=docs.select("doc_id", "text"), benchmark=bench.select("item_id", "text")).fetchall()
    assert sorted(theirs, key=repr) == sorted(expected, key=repr)
    if limit is None:
        kept = contamination.keep_clean(docs, bench)
        assert kept.dtypes == docs.dtypes and sorted(map(repr, (r["doc_id"] for r in kept.collect()))) == sorted(repr(x[0]) for x in expected if not x[-1])
        assert contamination.decontaminate(docs.limit(0), bench).count() == 0
        assert not any(r["contaminated"] for r in contamination.decontaminate(docs, bench.limit(0)).collect())
        plan = ours._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas", plan)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# -- URL lists


def test_captures_are_judged_as_of_their_time(spark):
    rng = random.Random(11)
    hosts = ["a.example.com", "example.com", "b.a.example.com", "other.org", "notexample.com"]
    entries = ["d:example.com", "d:a.example.com", "p:example.com/x", "p:other.org/x/y", "d:org"]
    events = [(rng.choice("LM"), rng.choice(entries), rng.choice(["add", "remove"]), rng.randrange(20)) for _ in range(60)] + [(None, "d:org", "add", 1), ("L", None, "add", 1), ("L", "d:org", "add", None), ("L", "d:org", "flag", 1)]
    urls = [f"{rng.choice(['http', 'HTTPS'])}://{rng.choice(['', 'u:p@'])}{rng.choice(hosts).upper()}{rng.choice(['', ':80', '.'])}{rng.choice(['', '/', '/x', '/x/y?q=/z', '/xy', '/x/#f'])}" for _ in range(150)]
    captures = [(i, u, rng.randrange(22)) for i, u in enumerate(urls)] + [(900, None, 3), (901, "no url", 3), (902, "http://example.com", None), (903, "http://example.com/" + "s/" * 3000, 3), (0, urls[0], 5), (0, urls[0], 5)]
    state = {}
    for key in {(e[0], e[1]) for e in events if None not in e}:
        state[key] = sorted({(at, action) for name, entry, action, at in events if (name, entry) == key and at is not None and action in ("add", "remove")})

    def judged(url, at):
        m = re.match(r"(?i)https?://(?:[^/?#@]*@)?([^/?#:@]+)(?::\d*)?([^?#]*)", url or "")
        if not m or at is None:
            return ""
        host, path = m[1].lower().removesuffix("."), [x for x in m[2].split("/") if x]
        on = set()
        for (name, entry), log in state.items():
            last = [action for t, action in log if t <= at]
            covers = host == entry[2:] or host.endswith("." + entry[2:]) if entry[0] == "d" else [host, *path][: entry.count("/") + 1] == entry[2:].split("/")
            if last and last[-1] == "add" and covers:
                on.add(name)
        return ",".join(sorted(on))

    c = spark.createDataFrame([(*x, "extra") for x in captures], "page_id long, url string, fetched_at int, lists string")
    e = spark.createDataFrame(events, "list string, entry string, action string, at int")
    got = sorted((r["page_id"], r["fetched_at"], r["lists"]) for r in url_lists.judge(c, e).collect() if r["fetched_at"] is not None)
    assert got == sorted((i, at, judged(u, at)) for i, u, at in captures if at is not None)
    assert url_lists.judge(c, e.limit(0)).where("n_lists > 0").count() == 0 and url_lists.judge(c.limit(0), e).count() == 0


def test_url_query_equals_its_sql(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"https://{h}/{p}") for i, (h, p) in enumerate(itertools.product(["www.cheap-pills.example.com", "tionsh.example.net", "ththan.example.net", "m.ththth.example.net", "thther.example.org"], ["fr", "fr/1", "en/9?x=/fr", "frx"]))], "page_id long, url string")
    pages = pages.unionByName(pages.select((F.col("page_id") * 37 + 100).alias("page_id"), "url")).unionByName(pages)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    ours = queries.op5_url_lists(spark, str(tmp_path))
    theirs = oracle(queries.OP5_SQL, pages=pages)
    names = [c[0] for c in theirs.description]
    assert sorted(map(repr, (tuple(r) for r in ours.select(*names).collect()))) == sorted(map(repr, theirs.fetchall()))


# -- the pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, documents, tmp_path):
    rng = random.Random(12)
    english, german = [[f"{stem}{i}" for i in range(400)] for stem in ("the", "über")]
    text = lambda v, n: " ".join(rng.choice(v) for _ in range(n))
    rows = [(i, text(english if i % 3 else german, rng.randrange(30, 120)), "en" if i % 3 else "de") for i in range(240)]
    rows += [(300 + i, rows[i][1] + " more", rows[i][2]) for i in range(20)]  # near copies
    item = text(english, 40)
    rows += [(400 + i, text(english, 60) + " " + item, "en") for i in range(5)]  # contaminated
    rows += [(500, text(english, 50) + " password=b7db7aa4a5fcc78305", "en"), (501, None, "en"), (502, "%% 123", "de")]
    documents(rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    known = [(i, t) for i, t, _ in rows if i not in (501, 502)]
    _, of = brute_sets(known)
    expected = {i: t for i, t in known if of[i] == i and not 400 <= i < 405}
    assert set(out) == set(expected) and 300 not in out
    from lodestar.llm.pieces import codec

    for i, t in expected.items():
        assert list(out[i]["ids"]) == codec().lib.encode(t.replace("b7db7aa4a5fcc78305", "[SECRET]"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "sentencepiece"]
    assert common.release(spark) > 0
