"""op8 and op4 against plain Python."""

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tablesmith.llm import mixing, simhash
from tablesmith.llm.queries import QUERIES


def test_fingerprints(edge_rows):
    for r in edge_rows:
        assert simhash.fingerprint(r[1]) % (1 << 64) == brute.fingerprint(r[1])


def test_components(spark, table_dir, edge_rows):
    fps = {brute.fingerprint(r[1]) for r in edge_rows}
    root = brute.groups(fps, lambda a, b: bin(a ^ b).count("1") <= 4)
    low = {}
    for r in edge_rows:
        k = root[brute.fingerprint(r[1])]
        if r[0] is not None:
            low[k] = min(low.get(k, r[0]), r[0])
    want = sorted(((r[0], f"{brute.fingerprint(r[1]):016x}", low.get(root[brute.fingerprint(r[1])])) for r in edge_rows),
                  key=repr)
    assert sorted(map(tuple, QUERIES["op8_simhash"](spark, table_dir).collect()), key=repr) == want


@pytest.mark.parametrize("max_block", [10_000, 16])
def test_links_of_dense_clusters(spark, monkeypatch, max_block):
    """Many fingerprints a few bits apart, chains, and far ones; once with split blocks."""
    monkeypatch.setattr(simhash, "MAX_BLOCK", max_block)
    rng = np.random.default_rng(1)
    fps = set(rng.integers(0, 1 << 63, 150).tolist())
    for centre in list(fps)[:5]:
        x = centre
        for _ in range(40):
            x ^= sum(1 << int(b) for b in rng.choice(63, 3, replace=False))
            fps.add(x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = dict(map(tuple, simhash.components(simhash.links(df, len(fps))).collect()))
    want = brute.groups(fps, lambda a, b: bin((a ^ b) & (2 ** 64 - 1)).count("1") <= 4)
    assert {f: got.get(f, f) for f in fps} == want


def test_more_bands_are_exact_too(spark, monkeypatch):
    monkeypatch.setattr(simhash, "bands_for", lambda count, radius: 7)
    test_links_of_dense_clusters(spark, monkeypatch, 10_000)
    assert simhash.band_bits(5)[-1][0] + simhash.band_bits(5)[-1][1] == 64


def test_bands_grow():
    monotone = [simhash.bands_for(n, 4) for n in (10, 10 ** 6, 10 ** 8, 10 ** 10)]
    assert monotone == [5, 5, 6, 7] or monotone == sorted(monotone)


def test_bk_forest_equals_scan():
    rng = np.random.default_rng(5)
    fps = np.unique(rng.integers(0, 1 << 12, 300).astype(np.uint64))
    tree = (fps % np.uint64(3)).astype(np.int64)
    forest = simhash.BKForest(fps, tree)
    got = {(int(q), int(n)) for qs, ns in forest.within(np.arange(len(fps)), 2) for q, n in zip(qs, ns, strict=True)}
    want = {(i, j) for i in range(len(fps)) for j in range(len(fps))
            if tree[i] == tree[j] and bin(int(fps[i] ^ fps[j])).count("1") <= 2}
    assert got == want


def test_keep_one(spark, edge):
    kept = simhash.keep_one(edge).collect()
    groups = simhash.dedup(edge).select("root").distinct().count()
    assert len(kept) == groups and simhash.keep_one(edge).columns == edge.columns
    assert 4 in {r["doc_id"] for r in kept} and 5 not in {r["doc_id"] for r in kept}


def test_empty(spark, empty, empty_dir):
    assert QUERIES["op8_simhash"](spark, empty_dir).collect() == []
    assert simhash.keep_one(empty).collect() == [] and mixing.mixed_documents(empty).collect() == []
    assert QUERIES["op4_mixing"](spark, empty_dir).collect() == []


def test_targets_equal_resharing():
    for sizes in ({"a": 100, "b": 1, "c": 50, None: 7}, {"x": 5}, {"a": 0, "b": 3}, {f"s{i}": i * i + 1 for i in range(17)}):
        want = brute.targets(sizes)
        got = mixing.water_fill(list(sizes.items()))
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_mix_on_edges(spark, table_dir, edge_rows):
    rows = QUERIES["op4_mixing"](spark, table_dir).collect()
    sizes = {}
    for r in edge_rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.WORD.findall(r[1] or ""))
    want = brute.targets(sizes)
    assert len(rows) == len(edge_rows)
    by_size = {v: want[k] for k, v in sizes.items()}
    for r in rows:
        assert abs(r["target"] - by_size[r["source_size"]]) < 1e-6
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0) <= (r["taken"] == 0)
        assert r["size"] == 0 or r["taken"] % r["size"] == 0


def plain_mix(rows, targets):
    """Weighted fair queueing in one list: (finish, ...) of every repeat, cut at the budget."""
    queue = []
    for source, own in rows.items():
        total, end = sum(s for _, s in own), 0
        for doc, size in own:
            end += size
            queue += [((e * total + end) / targets[source], source, doc, size) for e in range(3)]
    left, out = sum(targets.values()) + 0.5, {}
    for _, _, doc, size in sorted(queue):
        if size > left:
            break
        left -= size
        out[doc] = out.get(doc, 0) + size
    return out


@pytest.mark.parametrize("per_range", [mixing.ROWS_PER_RANGE, 7])
def test_mix_equals_one_list(spark, docs, monkeypatch, per_range):
    """With one range the order is the hash order; with many, ranges first. Both are one queue cut at the budget."""
    monkeypatch.setattr(mixing, "ROWS_PER_RANGE", per_range)
    some = docs.where("source IN ('src0', 'src1', 'src2', 'src3')")
    ranges = max(1, some.count() // per_range)
    place = F.xxhash64("doc_id", "text")
    order = some.select("source", "doc_id", mixing.word_count(F.col("text")).alias("n"), place.alias("p"),
                        F.pmod(place, F.lit(ranges)).alias("part")).orderBy("part", "p").collect()
    rows = {}
    for r in order:
        rows.setdefault(r["source"], []).append((r["doc_id"], r["n"]))
    targets = mixing.water_fill([(s, sum(n for _, n in own)) for s, own in rows.items()])
    got = {r["doc_id"]: r["taken"] for r in mixing.mix(some).collect() if r["taken"]}
    assert got == plain_mix(rows, targets)


def test_mixed_documents_repeat(docs):
    taken = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()} == taken


def test_sources_come_near_their_targets(docs):
    out = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 2 * r["most"] for r in out)


def small_corpus(spark, sources):
    """sources: name -> sizes of its documents in words."""
    rows = [(s, n) for s, sizes in sources.items() for n in sizes]
    return spark.createDataFrame([(i, "w " * n, s) for i, (s, n) in enumerate(rows)], "doc_id long, text string, source string")


def check_mix(docs):
    rows = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    total = sum(r["size"] for r in rows)
    taken = sum(r["taken"] for r in rows)
    assert taken <= total and all(r["taken"] <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        got = by.setdefault(r["source"], [0, r["target"], 0])
        got[0], got[2] = got[0] + r["taken"], max(got[2], r["size"])
    assert all(abs(t - target) <= 2 * most + max(m for *_, m in by.values()) for t, target, most in by.values()), by
    return by


def test_an_oversized_document_does_not_end_the_mix(spark):
    """Its virtual finish time is beyond 20 while all other sources are through at 1."""
    sources = {f"s{i:02}": [1] * (10, 4, 2)[i % 3] for i in range(9)}
    by = check_mix(small_corpus(spark, sources | {"t0": [10], "t1": [4], "t2": [130]}))
    assert by["t2"][:2] == [0, 6.0] and sum(t for t, *_ in by.values()) == 186
    assert by["s00"][0] == 30 and by["s01"][0] == 12 and by["s02"][0] == 6


@pytest.mark.parametrize("seed", range(4))
def test_random_skewed_sources(spark, monkeypatch, seed):
    monkeypatch.setattr(mixing, "STEP_ROWS", 3)
    monkeypatch.setattr(mixing._end_of, "__defaults__", (4, 3))  # many rounds of narrowing
    rng = np.random.default_rng(seed)
    sources = {f"s{i}": (rng.pareto(1.0, rng.integers(1, 9)) * 3 + 1).astype(int).tolist() for i in range(rng.integers(1, 9))}
    sources[f"s{rng.integers(0, len(sources))}"] = [int(rng.integers(200, 400)), 1, 1]
    docs = small_corpus(spark, sources)
    check_mix(docs)
    place = F.xxhash64("doc_id", "text")
    rows = {}
    for r in docs.select("source", "doc_id", mixing.word_count(F.col("text")).alias("n"), place.alias("p")).orderBy("p").collect():
        rows.setdefault(r["source"], []).append((r["doc_id"], r["n"]))
    targets = mixing.water_fill([(s, sum(n for _, n in own)) for s, own in rows.items()])
    assert {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect() if r["taken"]} == plain_mix(rows, targets)
