import os
import tempfile

import pytest

from tablesmith.sources import csv as CSV
from tablesmith.sources import multiline as M


def folder(*files: bytes) -> str:
    d = tempfile.mkdtemp(prefix="ts-csv-", dir="/tmp")
    for i, data in enumerate(files):
        with open(os.path.join(d, f"f{i}.csv"), "wb") as f:
            f.write(data)
    return d


def rows(result):
    return sorted(map(tuple, result.table.collect()))


@pytest.mark.parametrize("data", [b"a,b\n1,2\n3,4,5\n", b"a,b\n1,2\n3\n"])
def test_ragged_rows(spark, data):
    with pytest.raises(ValueError, match="1 rows do not have 2 fields"):
        CSV.load_csv(spark, folder(data))
    assert rows(CSV.load_csv(spark, folder(data), strict=False)) == [(1, 2)]
    assert CSV.ragged_rows(spark, folder(data)).count() == 1
    assert not CSV.check_structure(spark, folder(data))[0]


def test_quoted_line_ends_and_quotes(spark):
    got = rows(CSV.load_csv(spark, folder(b'a,b\n1,"x\ny"\n2,"q ""z"", w"\n')))
    assert got == [(1, "x\ny"), (2, 'q "z", w')]


def test_each_file_in_its_encoding(spark):
    got = CSV.load_csv(spark, folder("a,b\n1,café\n".encode(), "a,b\n2,café\n".encode("latin-1")))
    assert rows(got) == [(1, "café"), (2, "café")]
    assert got.metadata.first()["files"] == 2


def test_headers_must_agree(spark):
    with pytest.raises(ValueError, match="another header"):
        CSV.load_csv(spark, folder(b"a,b\n1,2\n", b"a,c\n3,4\n"))


def test_numbers_and_names(spark):
    got = CSV.load_csv(spark, folder(b"a,b\n12d,1.5\n2,2\n")).table
    assert dict(got.dtypes) == {"a": "string", "b": "double"}
    assert CSV.unique_names(["x", "x", "x_1", "X"]) == ["x", "x_2", "x_1", "X_3"]


def test_s03_writes_a_header_in_every_part(spark, tmp_path, monkeypatch):
    from tablesmith import suite
    whole = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
    whole.repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    load, seen = CSV.load_csv, []
    monkeypatch.setattr(CSV, "load_csv", lambda s, path: seen.append(path) or load(s, path))
    got = suite.QUERIES["s03_unique_names"](spark, str(tmp_path))
    assert got.columns == ["x", "x_2", "x_1"]
    want = whole.select("c_custkey", "c_nationkey", "c_acctbal").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want))
    files = spark.read.text(seen[0]).selectExpr("_metadata.file_path AS f", "value").where("value = 'x,x,x_1'").collect()
    assert len(files) == len({r["f"] for r in files}) == 3


# --- files with quoted line ends, read in byte ranges ---------------------------------

def state_by_character(line, inside):
    """Quote state after a line, one character at a time."""
    start, i = not inside, 0
    while i < len(line):
        c = line[i]
        if inside:
            if c == '"':
                if line[i + 1:i + 2] == '"':
                    i += 1
                else:
                    inside = False
        elif c == '"' and start:
            inside = True
        start = not inside and c == ","
        i += 1
    return inside


def test_quote_state_of_a_line():
    import itertools
    for n in range(6):
        for cells in itertools.product('",x', repeat=n):
            for inside in (False, True):
                assert M.ends_inside("".join(cells), inside) == state_by_character("".join(cells), inside), (cells, inside)


def small_ranges(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")


@pytest.fixture
def ranges_of(spark):
    yield lambda size: small_ranges(spark, size)
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


ODD_CELLS = ["plain", 'say "hi"', "two\nlines", "three\n\nlines\n", '"', '""\n"', ",\n,", '5" pipe', "x" * 60, "é\nü", "a\r\nb", '",\n"', "\n" * 40]


@pytest.mark.parametrize("size", ["64b", "200b", "1m"])
@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_records_over_byte_ranges(spark, ranges_of, size, line_end):
    """One file of records that cross ranges, cover whole ranges and end at range ends equals Python's csv module."""
    import csv as pycsv
    import io
    import random
    random.seed(len(size) + len(line_end))
    want = [(i, random.choice(ODD_CELLS), f"c{random.choice(ODD_CELLS)}") for i in range(150)]
    buffer = io.StringIO(newline="")
    pycsv.writer(buffer, lineterminator=line_end).writerows([("id", "b", "c"), *want])
    d = folder(buffer.getvalue().encode())
    ranges_of(size)
    got = CSV.load_csv(spark, d).table
    assert sorted(map(tuple, got.collect())) == want
    assert CSV.check_structure(spark, d)[0]


def test_one_file_is_read_by_many_tasks(spark, ranges_of):
    data = "a,b\n" + "".join(f'{i},"text {i}\nmore"\n' for i in range(20_000))
    d = folder(data.encode())
    ranges_of("20000b")
    ranges = M.scan_ranges(spark, [d], "UTF-8")
    assert len(ranges) > 15 and len({r["path"] for r in ranges}) == 1
    assert M._lines(spark, [d], "UTF-8").rdd.getNumPartitions() > 7
    table = CSV.load_csv(spark, d).table
    assert table.count() == 20_000 and table.where("b = concat('text ', a, chr(10), 'more')").count() == 20_000


def test_an_inch_sign_does_not_change_the_other_files(spark):
    got = CSV.load_csv(spark, folder(b'a,b\n1,5" pipe\n2,x\n', b"a,b\n3,y\n", "a,b\n4,é\n5,\"z\nz\"\n".encode("latin-1")))
    assert rows(got) == [(1, '5" pipe'), (2, "x"), (3, "y"), (4, "é"), (5, "z\nz")]
    assert got.metadata.first()["encoding"] == "ISO-8859-1/UTF-8"


def test_ragged_records_with_line_ends(spark):
    d = folder(b'a,b\n1,"x\ny"\n2,"p\nq",3\n')
    with pytest.raises(ValueError, match="1 rows do not have 2 fields"):
        CSV.load_csv(spark, d)
    assert rows(CSV.load_csv(spark, d, strict=False)) == [(1, "x\ny")]
    assert CSV.check_structure(spark, d) == (False, "1 of 2 rows do not have 2 fields")


def test_an_open_quote_is_an_error(spark):
    d = folder(b'a,b\n1,"never closed\n2,x\n')
    with pytest.raises(ValueError, match="not closed"):
        CSV.load_csv(spark, d)
    assert "not closed" in CSV.check_structure(spark, d)[1]


def test_header_with_a_line_end(spark):
    got = CSV.load_csv(spark, folder(b'"a\nb",c\n1,2\n', b'"a\nb",c\n3,4\n')).table
    assert got.columns == ["a\nb", "c"] and sorted(map(tuple, got.collect())) == [(1, 2), (3, 4)]


def test_carriage_returns_inside(spark):
    """A file with quoted line ends and bare carriage returns is read as a whole."""
    got = CSV.load_csv(spark, folder(b'a,b\r1,"x\ry"\r2,z\r'))
    assert rows(got) == [(1, "x\ry"), (2, "z")] or rows(got) == [(1, "x\ny"), (2, "z")]
