import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))

SF = "/root/testdata/sf0.001"
#: names that clash with what operators make
CLASH = ("size", "target", "words", "key", "spans", "fp", "score", "blob", "_text", "value")


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, odd characters."""
    texts = [None, "", "   \n\t", "x", "Hello World again and again", "Hello World again and again", "é" * 40, "a b c " * 4000,
             "ß日本語 テキスト 😀😀 token=abcdefghijklmnop", 'password: "short" secret=secret: abcdefghijklmnop token==aaaaaaaaaaaa',
             "AKIA" + "A" * 20 + " AKIAAKIAAAAA xAKIA 0123456789abcdef0 deadbeefdeadbeef",
             "mail a@b.c_x@y.zz.q q@@x.y first.last+tag@sub.domain.example 1.2.3.4.5.6 999.1.1.1 0001.2.3.4",
             "card 4111 1111 1111 1111 4111-1111-1111-1112 5500005555555559 +1 (555) 123-4567 +123 +1-2-3-4-5-6-7-8-9",
             "A" * 5000 + "." + "1" * 5000 + " 1" * 3000, "a.b." * 3000 + "@x" + ".y" * 2000,
             "line one\nline one\n\nline two\nline one\n| # $ |\n", "<|endoftext|> mid <|endoftext|>x", "  two  spaces   nbsp ",
             "one two three one two three one two three four", "UPPER!! CASE!! WORDS!!", "the quick brown fox jumps",
             "The Quick brown fox jumps", "the quick brown fox jumps over"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s0"][i % 4], None if t is None else len(t))
            for i, t in enumerate(texts)]
    return rows + [(None, "a row without an id", "en", "s1", 19), (None, None, None, None, None), rows[4], rows[4]]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(edge_rows, schema)
    from pyspark.sql import functions as F
    return df.withColumns({c: F.lit("clash") for c in CLASH}).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def table_dir(edge, tmp_path_factory):
    """A folder with the edge rows as documents."""
    path = str(tmp_path_factory.mktemp("edge"))
    edge.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="session")
def empty_dir(empty, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none"))
    empty.write.parquet(f"{path}/documents.parquet")
    return path
