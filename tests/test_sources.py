import os
import tempfile

from pyspark.sql import functions as F

from tablesmith.sources import csv as CSV
from tablesmith.sources import sinks as SK


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)


def test_csv_tokens_types_and_duplicate_header(spark):
    d = tempfile.mkdtemp(prefix="ts-csv-", dir="/tmp")
    p = os.path.join(d, "a.csv")
    _write(p, b"a,a,b,c,flag\n1,x,NA,1.5,True\n2,y,,2.5,False\n3,NaN,7,n/a,True\n")
    res = CSV.load_csv(spark, p)
    t = res.table
    assert t.columns == ["a", "a_1", "b", "c", "flag"]
    types = dict(t.dtypes)
    assert types["a"] == "bigint" and types["b"] == "double" and types["c"] == "double" and types["flag"] == "boolean"
    assert t.where(F.col("a_1").isNull()).count() == 1 and t.where(F.col("b").isNull()).count() == 2
    m = res.metadata.first()
    assert (m.rows, m.columns, m.encoding) == (3, 5, "UTF-8")
    assert CSV.check_structure(spark, p)[0]


def test_encoding_audit_latin1(spark):
    d = tempfile.mkdtemp(prefix="ts-enc-", dir="/tmp")
    _write(os.path.join(d, "l.csv"), b"name\ncaf\xe9\n")
    _write(os.path.join(d, "u.csv"), "name\ncafé\n".encode())
    enc = {os.path.basename(r.path): r.encoding for r in CSV.encoding_audit(spark, d).collect()}
    assert enc == {"l.csv": "latin-1", "u.csv": "utf-8"}
    t = CSV.load_csv(spark, os.path.join(d, "l.csv")).table
    assert t.first()[0] == "café"


def test_structure_check_flags_ragged_rows(spark):
    d = tempfile.mkdtemp(prefix="ts-bad-", dir="/tmp")
    p = os.path.join(d, "b.csv")
    _write(p, b"a,b\n1,2\n3,4,5\n")
    ok, msg = CSV.check_structure(spark, p)
    assert not ok and "1 of 2" in msg


def test_decision_log(spark):
    path = tempfile.mkdtemp(prefix="ts-log-", dir="/tmp") + "/log"
    SK.log_decision(spark, path, "upload", "read", {"rows": 3})
    SK.log_decision(spark, path, "fix_applied", "filled x", {"column": "x"})
    rows = SK.read_log(spark, path).collect()
    assert [r.type for r in rows] == ["upload", "fix_applied"] and rows[0].details["rows"] == "3"
