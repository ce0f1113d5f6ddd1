"""op2: the Kneser-Ney models against a direct computation; accuracy on held-out documents."""

import math
from collections import Counter

import numpy as np
import zlib

from tablesmith.llm import langid
from tablesmith.llm.queries import QUERIES

TEXTS = {"aa": ["the cat sat on the mat", "a cat and a hat"], "bb": ["der hund und die katze", "ein hut"]}


def packed(text):
    return langid.grams(langid.symbols(text))


def small_model():
    langs, lang, gram, n = sorted(TEXTS), [], [], []
    for i, name in enumerate(langs):
        g, c = np.unique(np.concatenate([packed(t) for t in TEXTS[name]]), return_counts=True)
        lang, gram, n = [*lang, *[i] * len(g)], [*gram, *g.tolist()], [*n, *c.tolist()]
    return langid.Model(langs, np.array(lang), np.array(gram, dtype=np.uint64), np.array(n))


def direct(texts, every):
    """P(last sign | three before) by the recursion on strings. ``every``: the signs of all languages."""
    top = Counter()
    for t in texts:
        s = [chr(int(c)) for c in langid.symbols(t)]
        top.update("".join(s[i:i + 4]) for i in range(len(s) - 3))
    levels = {4: top}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
    discounts = {k: discount(levels[k]) for k in levels}

    def p(g):
        if not g:
            return 1 / (every + 1)
        k, c = len(g), levels[len(g)]
        same = {x: v for x, v in c.items() if x[:-1] == g[:-1]}
        if not same:
            return p(g[1:])
        total = sum(same.values())
        return max(same.get(g, 0) - discounts[k], 0) / total + discounts[k] * len(same) / total * p(g[1:])
    return p


def test_model_equals_recursion():
    model = small_model()
    every = len({c for ts in TEXTS.values() for t in ts for c in langid.symbols(t).tolist()})
    for i, name in enumerate(model.langs):
        p = direct(TEXTS[name], every)
        for text in ("the dog", "und zzz", "qqq", "katze sat"):
            s = [chr(int(c)) for c in langid.symbols(text)]
            want = [math.log(p("".join(s[j:j + 4]))) for j in range(len(s) - 3)]
            assert np.allclose(model.logprob(packed(text))[:, i], want, atol=1e-4)


def test_probabilities_sum_to_one():
    model = small_model()
    signs = sorted({int(c) for ts in TEXTS.values() for t in ts for c in langid.symbols(t)})
    context = [langid.BOUNDARY, ord("t"), ord("h")]
    g = np.array([context[0] << 48 | context[1] << 32 | context[2] << 16 | c for c in signs], dtype=np.uint64)
    total = np.exp(model.logprob(g).astype(float)).sum(0)
    assert np.all(total < 1) and np.all(total > 0.95)  # what is missing is left to unseen signs


def test_long_texts_in_pieces(monkeypatch):
    model = small_model()
    whole = model.cross_entropies(["the cat and der hund " * 200, "", "a hat"])
    monkeypatch.setattr(langid, "CHARS_AT_ONCE", 64)
    parts = model.cross_entropies(["the cat and der hund " * 200, "", "a hat"])
    assert np.array_equal(whole[0], parts[0]) and np.allclose(whole[1], parts[1])


def test_held_out_accuracy(docs):
    rows = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    gold = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in rows.items())
    own = [r for r in rows.values() if r["held_out"]]
    assert sum(r["lang_pred"] == gold[r["doc_id"]] for r in own) / len(own) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert sum(r["rejected"] for r in rows.values()) <= 0.02 * len(rows)


def test_held_out_documents_are_not_learnt_from(docs):
    from pyspark.sql import functions as F
    changed = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs).collect()}
    assert a == {r["doc_id"]: r["lang_pred"] for r in langid.identify(changed).collect()}


def test_no_count_is_left_out_beyond_the_broadcast(spark, docs, edge, monkeypatch):
    columns = ("doc_id", "lang_pred", "score", "rejected", "cross_entropy")
    def results(df):
        return sorted((tuple(r[c] for c in columns) for r in langid.identify(df).collect()), key=lambda r: (
            str(r[0]), str(r[4])))
    few = docs.limit(60).union(docs.where("lang IS NULL").limit(5)).select("doc_id", "text", "lang")
    other = edge.select("doc_id", "text", "lang")
    whole = [results(df) for df in (few, other)]
    kept = sorted(map(repr, langid.keep_known(edge).collect()))
    monkeypatch.setattr(langid, "MAX_NGRAMS", 100)
    for df, want in zip((few, other), whole, strict=True):
        got = results(df)
        assert len(got) == len(want)
        for a, b in zip(got, want, strict=True):
            assert a[:2] == b[:2] and a[3] == b[3] and np.isclose(a[2], b[2], atol=1e-4)
            assert a[4] == b[4] or np.isclose(a[4], b[4], atol=1e-4)
    assert sorted(map(repr, langid.keep_known(edge).collect())) == kept


def test_blocks_do_not_change_the_entropies(spark, docs, monkeypatch):
    monkeypatch.setattr(langid, "BLOCK_SIGNS", 3000)  # many blocks
    rows = docs.where("lang IS NOT NULL").limit(40).coalesce(1).cache()
    counts = langid.count_grams(rows.select("lang", "text")).cache()
    langs = sorted({r["lang"] for r in counts.select("lang").distinct().collect()})
    model = langid.SpreadModel(langs, counts)
    got = {r["row"]: r for r in model.entropies(rows.select(rows["doc_id"].alias("row"), "text")).collect()}
    c = counts.toPandas()
    whole = langid.Model(langs, np.searchsorted(langs, c["lang"].to_numpy().astype(str)),
                         c["gram"].to_numpy().view(np.uint64), c["n"].to_numpy())
    for r in rows.collect():
        n, total = whole.cross_entropies([r["text"]])
        assert got[r["doc_id"]]["signs"] == n[0]
        assert np.allclose(got[r["doc_id"]]["ce"], total[0] / max(1, n[0]), atol=1e-4)


def test_edges(spark, edge, empty, table_dir, empty_dir):
    rows = QUERIES["op2_language_id"](spark, table_dir).collect()
    assert len(rows) == edge.count()
    by_id = {r["doc_id"]: r for r in rows}
    for i in (0, 1, 2):
        assert by_id[i]["lang_pred"] == "und" and by_id[i]["score"] == 0.0 and by_id[i]["rejected"]
    assert {r["lang_pred"] for r in rows} <= {"und", "en", "de"}
    assert QUERIES["op2_language_id"](spark, empty_dir).collect() == []
    kept = langid.keep_known(edge)
    assert kept.columns == edge.columns and not {0, 1, 2} & {r["doc_id"] for r in kept.collect()}
    unlabelled = edge.withColumn("lang", edge["lang"].substr(100, 1).cast("string")).selectExpr(
        "doc_id", "text", "cast(null as string) as lang")
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}
