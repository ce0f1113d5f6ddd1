"""op9 against the tokenizers library, op10 against brute force, and the pipeline's stages."""

import hashlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from tablesmith.llm import ann, bpe
from tablesmith.llm.queries import QUERIES

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizers.path(VOCABULARY))


def digest(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_equal_to_library(spark, table_dir, edge_rows, library):
    got = sorted(tuple(r)[1:] for r in QUERIES["op9_bpe"](spark, table_dir).collect())
    assert got == sorted(digest(library, r[1]) for r in edge_rows)


def test_equal_on_documents(docs, library):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode(docs, VOCABULARY, ["doc_id"]).collect():
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == digest(library, texts[r["doc_id"]])
        assert len(r["token_ids"]) == r["n_tokens"]


def test_chunks_are_shared_and_repaired(library):
    codec = bpe.Codec(public_tokenizers.path(VOCABULARY))
    rng = np.random.default_rng(0)
    passage = " ".join("".join(rng.choice(list("abcdefgh"), rng.integers(1, 9))) for _ in range(4000))
    codec.encode("first " + passage)
    before = len(codec.chunks)
    codec.encode("another start of a text " + passage + " tail")
    assert before > 10 and len(codec.chunks) - before <= 4  # all but the outer chunks are found again
    bad = bpe.Codec(public_tokenizers.path(VOCABULARY))
    bad.cuts = lambda raw: list(range(5, len(raw), 5))  # cuts inside words: every join has to be repaired
    text = "unbelievable reconstruction of   words\n\n and 12345 numbers it's"
    assert list(bad.encode(text)[0]) == library.encode(text, add_special_tokens=False).ids
    assert bad.decode(bad.encode(text)[0]) == text


def test_store_is_bounded(docs):
    codec = bpe.Codec(public_tokenizers.path(VOCABULARY), cache_bytes=20_000)
    roomy = bpe.Codec(public_tokenizers.path(VOCABULARY))
    for r in docs.limit(40).collect():
        assert codec.encode(r["text"])[0] == roomy.encode(r["text"])[0]
    assert len(codec.chunks) < len(roomy.chunks)


def vectors(spark, n=600, dim=16):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[50:60] = x[40]  # equal vectors: ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(1000, None), (1020, [0.0] * dim), (1040, [float("nan")] * dim), (1060, [float("inf")] * dim),
           (1080, [None] * dim), (1100, [1.0, 2.0]), (None, x[0].tolist()), (20, x[20].tolist()), (40, x[40].tolist())]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")


def brute_force(x, q, k):
    s = (x.astype(float) * x[q].astype(float)).sum(1)
    order = np.lexsort((np.arange(len(x)), -s))
    return [(int(i), float(s[i])) for i in order[order != q][:k]]


def test_whole_share_is_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 50)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    x, df = vectors(spark)
    got = {}
    for r in ann.search(df, every=20, share=1.0, centroids=8).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 600, 20))
    for q, rows in got.items():
        assert [(i, s) for _, i, s in sorted(rows)] == brute_force(x, q, 20)
        assert [r for r, _, _ in sorted(rows)] == list(range(1, 21))


@pytest.mark.parametrize("n", [300, 3000])
def test_recall(spark, n):
    x, df = vectors(spark, n, 32)
    hit = total = 0
    got = {}
    for r in ann.search(df, every=20).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    for q, ids in got.items():
        want = {i for i, _ in brute_force(x, q, 20)}
        hit, total = hit + len(want & ids), total + 20
    assert hit / total >= 0.9


def test_walk_goes_by_falling_sum():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=6), rng.normal(size=5)
    order, last = ann.walk(a, b, np.ones(30, int), 30)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert len(set(order)) == 30 and sums == sorted(sums, reverse=True)
    assert last == sums[-1]
    cells, last = ann.walk(a, b, np.full(30, 10), 35)
    assert cells == order[:4] and last == sums[3]
    empty = np.ones(30, int)
    empty[order[:3]] = 0
    assert ann.walk(a, b, empty, 5)[0] == order[3:8]


def test_walk_length_meets_the_recall():
    """The walk of the length found holds the cells of that share of the true neighbours, one shorter does not."""
    rng = np.random.default_rng(4)
    a, b, held = rng.normal(size=(5, 6)), rng.normal(size=(5, 7)), rng.integers(0, 9, 42)
    true = pd.DataFrame({"q": np.repeat(np.arange(5), 8), "cell": rng.choice(np.flatnonzero(held), 40)})

    def met(wanted):
        walked = [set(ann.walk(a[q], b[q], held, wanted)[0]) for q in range(5)]
        return np.mean([c in walked[q] for q, c in zip(true["q"], true["cell"], strict=True)])

    n = ann.walk_length(a, b, held, true, 0.9)
    assert met(n) >= 0.9 > met(n - 1)


def test_equal_ids_and_other_lengths_are_kept(spark):
    """Rows that share an id are all candidates and each a query; vectors of another length have their own index."""
    df = spark.createDataFrame([(20, [1.0, 0.0]), (21, [2.0, 2.0]), (21, [9.0, 9.0]), (21, [9.0, 9.0]), (40, [0.0, 1.0]),
                                (40, [3.0, 0.0]), (60, [1.0, 1.0, 1.0]), (61, [1.0, 2.0, 3.0]), (80, [5.0])],
                               "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, every=20).orderBy("rank").collect():
        got.setdefault((r["query_id"], r["rank"]), []).append((r["vec_id"], r["score"]))
    assert {q: got[20, q] for q in range(1, 5)} == {1: [(21, 9.0)], 2: [(40, 3.0)], 3: [(21, 2.0)], 4: [(40, 0.0)]}
    assert sorted(got[40, 1]) == [(21, 9.0), (21, 27.0)] and sorted(got[40, 4]) == [(40, 0.0), (40, 0.0)]
    assert got[60, 1] == [(61, 6.0)] and (60, 2) not in got and (80, 1) not in got


def test_copies_do_not_end_the_walk(spark):
    """A third of the rows are one vector: the others' neighbours are still found."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[500:1000] = x[500]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    hit = total = 0
    for q, rows in pd.DataFrame(map(tuple, ann.search(df, every=20).collect()), columns=list("qrvs")).groupby("q"):
        hit, total = hit + len({i for i, _ in brute_force(x, q, 20)} & set(rows["v"])), total + 20
    assert total == 1500 and hit / total >= 0.9


def test_large_cells_are_split():
    first, parts = ann.shards_of(np.array([5, 100, 3, 0, 250]), 50)
    assert parts.tolist() == [1, 2, 1, 1, 5]
    spans = [set(range(f, f + p)) for f, p in zip(first, parts, strict=True)]
    assert not spans[1] & spans[4] and not spans[1] & spans[0]


def test_few_and_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 3.0]), (20, [1.0, 0.0, 1.0]), (21, [0.5, 1.0, 0.0])],
                               "vec_id long, embedding array<float>")
    got = sorted(map(tuple, ann.search(df, every=20).collect()))
    assert got == [(0, 1, 20, 4.0), (0, 2, 21, 2.5), (20, 1, 0, 4.0), (20, 2, 21, 0.5)]
    assert ann.search(df.where("false"), every=20).collect() == []


def test_pipeline(spark, edge, library):
    import corpus_pipeline as P
    assert [name for name, _ in P.STAGES] == ["language ID", "SimHash near-dedup", "PII", "mixing to target weights", "BPE"]
    rows = edge
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, rows, "")
        assert out.columns == edge.columns, name
        rows = spark.createDataFrame(out.collect(), out.schema)
        assert rows.count() > 0
    final = P.STAGES[-1][1](spark, rows, "").collect()
    want = sorted(digest(library, r["text"]) for r in rows.collect())
    assert sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in final) == want
    none = edge.where("false")
    for _, stage in P.STAGES:
        none = stage(spark, none, "")
        assert none.collect() == []
        none = edge.where("false")
