"""op11 against dense arithmetic, op12 against the sentencepiece library, op13 against a dictionary of prefixes."""

import hashlib
import math
import re

import numpy as np
import public_tokenizers
import pytest
import trie_brute

from tablesmith.llm import pieces, turntrie, whitening
from tablesmith.llm.queries import QUERIES

VOCABULARY = "piece_bpe_32k.model"
SF = "/root/testdata/sf0.001"


# --- op11 --------------------------------------------------------------------------

def brute_whitening(vectors):
    x = np.array([[math.floor(64 * float(c)) + 1000000 for c in v] for v in vectors], dtype=object)
    u = np.array(sorted(set(map(tuple, x))), dtype=object)
    n, s = len(u), u.sum(axis=0)
    v = np.array([[int(a) / (n * n) for a in row] for row in n * u.T.dot(u) - np.multiply.outer(s, s)], dtype=float)
    values, vectors = np.linalg.eigh(v)
    dev = n * x - s
    return n, (dev * dev).sum(axis=1), (dev / n).astype(float) @ vectors[:, ::-1], values[::-1], np.trace(v)


def test_block_scatter_is_exact():
    rng = np.random.default_rng(0)
    for n, d, spread in ((1, 3, 5), (200, 7, 300), (130, 2, 1 << 40), (65, 1, 1), (64, 4, 2)):
        x = 1_000_000 + rng.integers(-spread, spread, (n, d))
        sums, cross = whitening.block_scatter(x)
        about = x.astype(object) - 1_000_000
        assert (sums == about.sum(axis=0)).all() and (cross == about.T.dot(about)).all()


def test_whitening_on_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    n, deviation, z, values, trace = brute_whitening([r["embedding"] for r in rows])
    got = {(r["vec_id"], r["component"]): r for r in QUERIES["op11_whitening"](spark, SF).collect()}
    assert len(got) == len(rows) * 16
    rank = min(n - 1, 16)
    for i, r in enumerate(rows):
        for k in range(rank):
            g = got[r["vec_id"], k + 1]
            assert g["n"] == n and g["deviation"] == deviation[i] and g["identity_error"] < 1e-9
            assert abs(abs(g["whitened"]) - abs(z[i, k]) / math.sqrt(values[k])) < 1e-8
            assert abs(g["explained"] - values[k] / trace) < 1e-9


def test_whitening_on_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(1)
    good = [(i, rng.normal(size=3).round(2).tolist()) for i in range(40)]
    rows = good + [good[3], (None, good[4][1]), (77, [1.0, None, 2.0]), (78, None), (79, [nan, 0.0, 0.0]), (80, [0.0, 0.0, inf]),
                   (81, []), (82, [5.0]), ((1 << 60) + 1, good[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS n", "'a' AS _x", "2 AS component")
    got = whitening.whiten(df).collect()
    ids = [r["vec_id"] for r in got]
    assert len(got) == 44 and ids.count(3) == 2 and (1 << 60) + 1 in ids and None in ids and 82 in ids
    n, deviation, *_ = brute_whitening([v for _, v in good])
    assert {r["n"] for r in got if r["vec_id"] != 82} == {n}
    assert {int(r["deviation"]) for r in got if r["vec_id"] in range(40)} == set(deviation)
    alone = next(r for r in got if r["vec_id"] == 82)  # one vector of its length: no variance
    assert (alone["n"], int(alone["deviation"]), alone["whitened"], alone["explained"], alone["identity_error"]) == (1, 0, [None], [0.0], 0.0)
    assert whitening.whiten(df.where("false")).collect() == []


def test_whitening_counts_a_repeated_vector_once(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(300, [0.0, 1.0]), (301, [2.0, -1.0])]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 302 and {r["n"] for r in got} == {3} and max(r["identity_error"] for r in got) < 1e-9


# --- op12 --------------------------------------------------------------------------

@pytest.fixture(scope="module")
def own():
    return pieces.PieceCodec(public_tokenizers.path(VOCABULARY))


def test_pieces_equal_the_library(spark, edge_rows, edge, own):
    got = pieces.encode(edge, VOCABULARY, ["doc_id", "key"]).collect()
    want = sorted(own.library.encode(r[1] or "") for r in edge_rows)
    assert sorted(r["token_ids"] for r in got) == want and all(r["agrees"] and r["key"] == "clash" for r in got)
    for r in got:
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, r["token_ids"])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.library.decode(r["token_ids"]).encode()).hexdigest()


def test_pieces_on_documents(spark, table_dir, empty_dir, edge_rows, docs):
    rows = QUERIES["op12_pieces"](spark, SF).collect()
    assert len(rows) == docs.count() and all(r["agrees"] for r in rows)
    assert len(QUERIES["op12_pieces"](spark, table_dir).collect()) == len(edge_rows)
    assert QUERIES["op12_pieces"](spark, empty_dir).collect() == []


def test_large_ids_beside_null_ids(spark):
    df = spark.createDataFrame([((1 << 60) + 1, "a"), (None, "b")], "doc_id long, text string")
    assert {r["doc_id"] for r in pieces.encode(df, VOCABULARY, ["doc_id"]).collect()} == {(1 << 60) + 1, None}


def test_agenda_takes_the_best_score_then_the_leftmost_pair(own):
    for text in ("▁aaaaaaa", "▁▁▁▁▁▁▁", "▁unbelievable", "▁日本語", "aaaabaaab" * 30, "▁" * 501):
        plain = list(text)
        while True:
            pairs = [(own.cost[a + b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if a + b in own.cost]
            if not pairs:
                break
            _, i = min(pairs)
            plain[i:i + 2] = ["".join(plain[i:i + 2])]
        want = [t for p in plain for t in ([own.ids[p]] if p in own.ids else [own.byte_ids[b] for b in p.encode()])]
        assert own.agenda(text) == want


def test_cuts_and_store_change_no_id(own):
    rng = np.random.default_rng(3)
    small = pieces.PieceCodec(public_tokenizers.path(VOCABULARY), store_bytes=3000)
    signs = list("abeginstrdABC ..,,''\"-▁\n\t1200é日😀ｆ|#")
    for _ in range(300):
        text = "".join(rng.choice(signs, rng.integers(1, 60)))
        want = own.library.encode(text)
        assert own.encode(text) == small.encode(text) == own.agenda(own.library.normalize(text)) == want
        assert own.joined(want)[1].decode() == own.decode(want) == own.library.decode(want)
    small.tokens = None  # a vocabulary whose pieces cross word marks is not cut by the pattern
    assert small.encode("some words, and more") == own.encode("some words, and more")


def test_decode_of_any_ids(own):
    rng = np.random.default_rng(4)
    for _ in range(2000):
        ids = rng.choice([0, 1, 2, *range(3, 259), *range(259, 32000, 101)], rng.integers(0, 12)).tolist()
        assert own.decode(ids) == own.library.decode(ids)


# --- op13 --------------------------------------------------------------------------

def test_findclose():
    rng = np.random.default_rng(5)
    for size in (1, 2, 3, 40, 700):
        bits, held = [1], 1
        for _ in range(size):
            up = held == 1 or rng.random() < 0.5
            bits.append(int(up))
            held += 1 if up else -1
        bits = np.array(bits + [0] * held, dtype=np.int8)
        stack, want = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                want[stack.pop()] = i
        opens = np.flatnonzero(bits)
        for block in (2, 64):
            assert dict(zip(opens.tolist(), turntrie.RangeMinMax(bits, block).findclose(opens).tolist())) == want


def test_range_min():
    values = np.random.default_rng(6).integers(0, 99, 77)
    a, b = np.triu_indices(78, 1)
    assert (turntrie.RangeMin(values).smallest(a, b) == [values[i:j].min() for i, j in zip(a, b)]).all()


TURNS = "conv_id long, turn long, role string, text string"


def conversations():
    """Shared heads, equal and prefix conversations, gaps, nulls, tied and repeated turns."""
    rng = np.random.default_rng(7)
    rows = []
    for c in [*range(0, 260, 3), *range(100, 160), -5, -100, 10 ** 12]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][t % 3], ["hi", "", None, "longer text é", f"own {c % 4}"][int(rng.integers(0, 5))]))
    same = [(t, "user", f"same {t}") for t in range(9)]
    rows += [(c, *t) for c in range(300, 420) for t in same]
    return rows + [(7, None, "user", "null turn"), (7, 1, "user", "tie b"), (7, 1, "user", "tie a"), (7, 1, "user", "tie a"),
                   (None, 0, "user", "no conversation"), (8, 0, None, None)]


@pytest.mark.parametrize("block_turns,range_turns", [(turntrie.BLOCK_TURNS, turntrie.RANGE_TURNS), (300, 900), (1, 40)])
def test_trie_equals_dictionary(spark, block_turns, range_turns):
    rows = conversations()
    df = spark.createDataFrame(rows, TURNS).selectExpr("*", "'x' AS key", "1 AS depth", "2 AS shard")
    got = sorted(map(tuple, turntrie.prefix_trie(df, block_turns, range_turns).collect()))
    assert got == trie_brute.nodes(rows)


def test_trie_on_table(spark):
    df = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = list(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))
    out = QUERIES["op13_prefix_trie"](spark, SF)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, out.collect())) == trie_brute.nodes(rows)


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert turntrie.prefix_trie(df).collect() == []
    assert turntrie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b")], TURNS)).collect() == []


def test_a_conversation_beyond_the_bound_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(turntrie, "MAX_TURNS", 3)
    df = spark.createDataFrame([(1, t, "a", "b") for t in range(4)], TURNS)
    with pytest.raises(Exception, match="more than 3 turns"):
        turntrie.prefix_trie(df).collect()


def test_tokens_and_joined_values_are_plain(own):
    """The pattern never goes back over a repeat, and joined values come from one call for all ids."""
    assert "++" in own.tokens.pattern and "*+" in own.tokens.pattern
    plain = re.compile(own.tokens.pattern.replace("++", "+").replace("*+", "*").replace("?+", "?"))
    rng = np.random.default_rng(8)
    signs = list("abeginstrdABC ..,,''\"-▁▁\n\t12é日😀ｆ|#")
    for size in (0, 1, 2, *rng.integers(1, 80, 200).tolist()):
        text = "".join(rng.choice(signs, size))
        assert own.tokens.findall(text) == plain.findall(text) and "".join(plain.findall(text)) == text
        ids = own.encode(text)
        assert own.joined(ids)[0] == ",".join(map(str, ids)).encode()
        assert own.raw(ids) == b"".join(own.out[i] for i in ids)


def test_store_counts_what_a_word_takes(own):
    from sys import getsizeof
    got = pieces.PieceCodec(public_tokenizers.path(VOCABULARY))
    words = [f"{pieces.MARK}{a}{b}{c}ing" for a in "bcdfglmnprst" for b in ("ea", "ou", "ai", "ie", "oo") for c in "bdgklmnprtvz"]
    for w in words:
        got.word(w)
    takes = sum(getsizeof(w) + getsizeof(ids) for w, ids in got.words.items()) + getsizeof(got.words)
    assert 0.9 * takes < got.held < 1.35 * takes


def test_short_words_share_one_agenda(own):
    rng = np.random.default_rng(9)
    signs = list("abeginstrdABC..,,''\"-▁▁\n\t12éßaaeé日😀ｆ|#")
    words = ["".join(rng.choice(signs, rng.integers(1, pieces.SHORT + 1))) for _ in range(3000)] + ["a\0", "\0", "▁", "日"]
    got = own.agendas(words)
    for word, packed in zip(words, got, strict=True):
        want = own.agenda(word)
        if packed is None:
            assert own.byte_ids[0] <= min(want) <= own.byte_ids[255]
        else:
            assert np.frombuffer(packed, np.int32).tolist() == want
    fresh = pieces.PieceCodec(public_tokenizers.path(VOCABULARY))
    calls, plain = [], fresh.agenda
    fresh.agenda = lambda text: calls.append(text) or plain(text)
    texts = ["some words of a first text, with some new words", "", "new words in another text"] * 3
    assert [np.frombuffer(p, np.int32).tolist() for p in fresh.encode_all(texts)] == fresh.library.encode(texts)
    assert calls == [] and not fresh.open  # no word had an agenda of its own


def test_equal_scores_take_the_leftmost_pair():
    got = pieces.PieceCodec(public_tokenizers.path(VOCABULARY))
    got.cost = {c: 0.0 for c in "abc"} | {p: 1.0 for p in ("ab", "bc", "abc", "bcab")}
    got.ids = {p: i for i, p in enumerate(got.cost)}
    got._number_symbols()
    words = ["abc", "bcab", "abcab", "cabcabc", "b", "bcabab"]
    assert [np.frombuffer(p, np.int32).tolist() for p in got.agendas(words)] == [got.agenda(w) for w in words]
