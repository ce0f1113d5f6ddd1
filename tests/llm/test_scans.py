"""op1 and op6: spans against plain Python, the ledger, the bootstrapping, redaction."""

import time
import tempfile

import brute
import duckdb
import pytest

from tablesmith.llm import pii, secrets
from tablesmith.llm.queries import QUERIES


def check(rows, texts, spans, kinds, extra):
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["base_sha256"], r)
    for _, text, *_ in texts:
        want = spans(text)
        got = by_text[brute.sha(",".join(want))]
        for k in kinds:
            assert got[f"n_{k}"] == sum(s.startswith(k + ":") for s in want)
        own = [s for s in got["spans"].split(",") if s and s.split(":")[0] not in extra]
        assert own == want


def test_secret_digest(spark, table_dir, edge_rows):
    rows = QUERIES["op1_secrets"](spark, table_dir).collect()
    check(rows, edge_rows, brute.secret_spans, ("assign", "access", "hex"), ("pem", "github", "jwt"))


def test_secret_oracle(spark, table_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{table_dir}/documents.parquet/*.parquet'")
    want = con.execute(secrets.ORACLE).fetchall()
    got = QUERIES["op1_secrets"](spark, table_dir).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ledger_scans_only_unseen_pairs(spark, edge):
    ledger = tempfile.mkdtemp(prefix="ts-ledger-", dir="/tmp") + "/l"
    first = secrets.RULES[:3]
    secrets.scan(edge.where("doc_id < 12"), ledger, first)
    n = secrets.read_ledger(spark, ledger).count()
    assert n == edge.where("doc_id < 12").selectExpr("coalesce(text, '')").distinct().count()
    secrets.scan(edge.where("doc_id < 12"), ledger, first)
    assert secrets.read_ledger(spark, ledger).count() == n  # nothing new
    secrets.scan(edge, ledger, secrets.RULES)  # new rules for old blobs, all rules for new ones
    again = secrets.read_ledger(spark, ledger)
    old = {r.blob for r in again.where("size(rules) = 3").collect()}
    assert {r.blob for r in again.where("size(rules) = 3 AND NOT array_contains(rules, 'pem@1')").collect()} == old
    whole = tempfile.mkdtemp(prefix="ts-ledger-", dir="/tmp") + "/w"
    secrets.scan(edge, whole)
    assert sorted(map(repr, secrets.findings(edge, ledger).collect())) == sorted(
        map(repr, secrets.findings(edge, whole).collect()))


def test_only_unseen_texts_move(spark, monkeypatch):
    """The bitmap lets all unseen blobs through and hardly any other; a small one only lets more through."""
    df = spark.range(5000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    texts = df.select(secrets.blob_id().alias("blob"), "text")
    blobs = texts.where("text LIKE '%7'").select("blob")
    for bits, most in ((1 << 26, 501), (1 << 15, 700), (8, 5000)):
        monkeypatch.setattr(secrets, "FILTER_BITS", bits)
        kept = {r["text"] for r in secrets.maybe_in(texts, blobs).collect()}
        assert {f"text {i}" for i in range(7, 5000, 10)} <= kept and len(kept) <= most
    assert secrets.maybe_in(texts, blobs.where("false")).collect() == []


def test_later_scans_add_what_is_new(spark):
    """A second version of some documents: only the new texts get entries; double entries do not double spans."""
    ledger = tempfile.mkdtemp(prefix="ts-ledger-", dir="/tmp") + "/l"
    old = spark.createDataFrame([(i, f"token = abcdefghijkl{i % 7}") for i in range(40)] + [(99, None)], "doc_id long, text string")
    new = old.unionByName(spark.createDataFrame([(100, "secret: ABCDEFGHIJKLMN"), (101, "secret: ABCDEFGHIJKLMN")], old.schema))
    secrets.scan(old, ledger)
    assert secrets.read_ledger(spark, ledger).count() == 8
    secrets.scan(new, ledger)
    assert secrets.read_ledger(spark, ledger).count() == 9
    want = sorted(map(repr, secrets.findings(new, ledger).collect()))
    secrets.read_ledger(spark, ledger).write.parquet(ledger + "-twice")
    secrets.read_ledger(spark, ledger).write.mode("append").parquet(ledger + "-twice")
    assert sorted(map(repr, secrets.findings(new, ledger + "-twice").collect())) == want and len(want) == 43


def test_added_rules(spark):
    text = "-----BEGIN RSA PRIVATE KEY----- ghp_" + "a1B2" * 10 + " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    ledger = tempfile.mkdtemp(prefix="ts-ledger-", dir="/tmp") + "/l"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    secrets.scan(df, ledger)
    assert {s["kind"] for s in secrets.findings(df, ledger).first()["spans"]} >= {"pem", "github", "jwt"}


def test_personal_digest(spark, table_dir, edge_rows):
    rows = QUERIES["op6_pii"](spark, table_dir).collect()
    check(rows, edge_rows, brute.personal_spans, ("email", "ip", "card", "phone"), ("ctx",))


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"note {i} member account number user{i}@mail.example and more words here") for i in range(12)]
    rows += [(100, "some text about account number ZX-99417 in a letter"), (101, "page number 77 of the book"),
             (102, "the year 1999 was warm")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["key"]: r["spans"] for r in pii.find(df).collect()}
    keys = {r["doc_id"]: r["k"] for r in df.select("doc_id", pii.text_key().alias("k")).collect()}
    start = rows[12][1].index("ZX-99417")
    assert [(s["ord"], s["start"], s["end"]) for s in found[keys[100]]] == [(4, start, start + 8)]
    assert keys[101] not in found and keys[102] not in found


def test_redaction(spark, edge):
    rows = [(1, "card 4111 1111 1111 1111; then 4111-1111-1111-1112, me@x.example or 10.0.0.1"), (2, "nothing here"), (3, None)]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_chars int")
    out = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert out[1]["text"] == "card [CARD]; then 4111-1111-1111-1112, [EMAIL] or [IP]"
    assert out[1]["n_chars"] == len(out[1]["text"]) and out[2]["text"] == rows[1][1] and out[3]["text"] is None
    whole = pii.redact(edge)
    assert whole.columns == edge.columns and whole.count() == edge.count()


def test_redaction_of_overlapping_spans(spark):
    rows = [(1, "call +1 555 123 4567 99bob@x.com now"),  # the phone runs into the e-mail
            (2, "at +1 555 123 4567 99bob@x.com, then me@x.example 10.0.0.1"),
            (3, "no 1.2.3.4@x.example here")]  # the IP lies inside the e-mail
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["key"]: [(s["ord"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find(df).collect()}
    first = next(r["k"] for r in df.where("doc_id = 1").select(pii.text_key().alias("k")).collect())
    (mail, phone) = spans[first]
    assert phone[1] < mail[1] < phone[2] < mail[2]  # a partial overlap
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out == {1: "call [PHONE] now", 2: "at [PHONE], then [EMAIL] [IP]", 3: "no [EMAIL] here"}


@pytest.mark.parametrize("name", ["op1_secrets", "op6_pii"])
def test_empty(spark, empty_dir, name):
    assert QUERIES[name](spark, empty_dir).collect() == []


def test_many_numbers_in_one_text(spark):
    """The overlap check of candidates and base entities is linear in a text's entities."""
    text = " ".join(f"no {i * 7919 % 1000003}" for i in range(100_000)) + " mail last@example.org"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    (row,) = pii.find(df).collect()
    assert [(s["ord"], s["end"]) for s in row["spans"] if s["ord"] < 4] == [(0, len(text))]
    assert time.time() - began < 120  # quadratic work took hours
