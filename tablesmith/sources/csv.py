"""CSV input (S1-S5): encoding audit, structure check, scan with pandas-like
missing tokens and whole-column type inference, duplicate header renaming,
and load metadata.

Everything is a Spark read: the header is one row of a text scan, the type of
each column is decided by one aggregate over the whole column (``try_cast``
counts), and the encoding audit checks the raw bytes of every line.
"""

from __future__ import annotations

import functools
import itertools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bounded, col
from .multiline import records, scan_ranges

# Text read as missing (the default missing markers of pandas' CSV reader)
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]


NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$|^[+-]?(?:inf|Inf|Infinity)$"
INTEGER = r"^[+-]?[0-9]+$"
MAX_FILES = 100_000


def _text_audit(spark: SparkSession, path: str) -> DataFrame:
    """One scan of the raw lines: per file its length, encoding, whether a quoted field
    runs over a line end, and whether the first header line found occurs in it."""
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    head = first[0][0] if first else ""
    quotes = F.char_length("value") - F.char_length(F.replace("value", F.lit('"'), F.lit("")))
    per_line = lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"),
        F.is_valid_utf8("value").alias("ok"), (quotes % 2 == 1).alias("odd"), (F.col("value") == head).alias("head"))
    return per_line.groupBy("path", "length").agg(
        F.when(F.bool_and("ok"), "utf-8").otherwise("latin-1").alias("encoding"),
        F.coalesce(F.bool_or("odd"), F.lit(False)).alias("multi_line"),
        F.coalesce(F.bool_or("head"), F.lit(False)).alias("has_header"))


def encoding_audit(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, length, encoding ('utf-8' when every line's
    bytes are valid UTF-8, else 'latin-1', which decodes any byte). The text
    source keeps each line's raw bytes and splits large files across tasks, so
    the check is per line and a file of any size is read in parallel."""
    return _text_audit(spark, path).select("path", "length", "encoding")


SPARK_ENCODING = {"utf-8": "UTF-8", "latin-1": "ISO-8859-1"}


def unique_names(names: list[str]) -> list[str]:
    """S3: the first column of a name keeps it; a later one gets the smallest number that
    makes a name no header field has. Names that differ only in case count as equal,
    as they do in Spark."""
    wanted, used, out = {n.lower() for n in names}, set(), []
    for name in names:
        tries = itertools.chain([name] if name.lower() not in used else [],
                                (t for t in (f"{name}_{i}" for i in itertools.count(1)) if t.lower() not in wanted))
        pick = next(t for t in tries if t.lower() not in used)
        used.add(pick.lower())
        out.append(pick)
    return out


def header(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool = False) -> list[str]:
    first = spark.read.options(header=False, encoding=encoding, escape='"', multiLine=multi_line).csv(path).limit(1).collect()
    if not first:
        raise ValueError("the file is empty")
    return [("" if v is None else v) for v in first[0]]


def _schema(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width)) + ", _extra string, _corrupt string"


def _read(spark: SparkSession, files: list, encoding: str | None, width: int) -> DataFrame:
    """Fields as text c0..., one spare field, and the raw row where the number of fields is another.
    Each file (a row of the audit) is read in its encoding. Files without quoted line ends are a plain CSV
    scan; in the others the records are found by a scan of the quote state over their byte ranges, so a file of
    any kind is read by many tasks. Only a file that has both quoted line ends and carriage returns
    elsewhere than at line ends is read as a whole."""
    plan: dict[tuple[str, str], list[str]] = {}
    scans: dict[str, list[dict]] = {}
    odd: dict[str, list[str]] = {}
    for f in files:
        charset = encoding or SPARK_ENCODING[f["encoding"]]
        if f["multi_line"]:
            odd.setdefault(charset, []).append(f["path"])
        else:
            plan.setdefault((charset, "lines"), []).append(f["path"])
    for charset, paths in odd.items():
        scans[charset] = scan_ranges(spark, paths, charset)
        whole = {r["path"] for r in scans[charset] if r["bare_cr"]}
        for p in paths:
            plan.setdefault((charset, "whole" if p in whole else "ranges"), []).append(p)
    options = dict(mode="PERMISSIVE", escape='"', columnNameOfCorruptRecord="_corrupt")
    parts = []
    for (charset, how), paths in sorted(plan.items()):
        if how == "ranges":
            own = set(paths)
            text = records(spark, paths, charset, [r for r in scans[charset] if r["path"] in own])
            parts.append(text.select(F.from_csv("record", F.lit(_schema(width)), options | {"multiLine": "true"}).alias("r")).select("r.*"))
        else:
            parts.append(spark.read.options(header=True, encoding=charset, multiLine=how == "whole", enforceSchema=True,
                                            **options).schema(_schema(width)).csv(paths))
    return functools.reduce(DataFrame.union, parts)


def infer_types(raw: DataFrame, extra: list | None = None, source: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """Whole-column inference over text columns (missing tokens already null):
    all values integral -> bigint (double when the column has gaps, as pandas
    does), numeric -> double, true/false words -> boolean, else string. One
    aggregate, which also counts the rows (``rows``) and what ``extra`` asks for (of ``source``,
    where that needs a column that ``raw`` lacks)."""
    aggs = [F.count(F.lit(1)).alias("rows"), *(extra or [])]
    for i, c in enumerate(raw.columns):
        v = col(c)
        whole = F.when(F.trim(v).rlike(INTEGER), v.try_cast("long"))
        number = F.when(F.trim(v).rlike(NUMBER), v.try_cast("double"))
        aggs += [F.count(v).alias(f"n{i}"), F.count(whole).alias(f"l{i}"), F.count(number).alias(f"d{i}"),
                 F.count(F.when(v.isin(TRUE_TOKENS + FALSE_TOKENS), 1)).alias(f"b{i}")]
    r = (source or raw).agg(*aggs).first().asDict()
    cols = []
    for i, c in enumerate(raw.columns):
        n, total, v = r[f"n{i}"], r["rows"], col(c)
        if n and r[f"l{i}"] == n:
            cols.append((v.try_cast("long") if n == total else v.try_cast("double")).alias(c))
        elif n and r[f"d{i}"] == n:
            cols.append(v.try_cast("double").alias(c))
        elif n and r[f"b{i}"] == n and n == total:
            cols.append(v.isin(TRUE_TOKENS).alias(c))
        else:
            cols.append(v.alias(c))
    return raw.select(*cols), r


def _common_header(spark: SparkSession, files: list, encoding: str | None) -> list[str]:
    """The header of the first file; another one in any file is an error. Most files are told by the audit."""
    def own(f):
        return header(spark, f["path"], encoding or SPARK_ENCODING[f["encoding"]], f["multi_line"])

    names = own(files[0])
    for f in files[1:]:
        if (not f["has_header"] or f["multi_line"]) and own(f) != names:
            raise ValueError(f"another header in {f['path']}")
    return names


@dataclass
class LoadResult:
    table: DataFrame
    metadata: DataFrame     # S4: rows, columns, bytes, files, encoding


def load_csv(spark: SparkSession, path: str, encoding: str | None = None, strict: bool = True) -> LoadResult:
    """Scan a CSV file or folder (header row, inferred types, missing tokens as null,
    duplicate names renamed). Each file is read in its own encoding unless one is given,
    and quoted line ends are kept. All files must have the same header. With ``strict`` a
    row of another field count than the header is an error; else such rows are dropped
    from the table and can be seen with ``ragged_rows``. An empty table is an error."""
    files = bounded(_text_audit(spark, path), "files", MAX_FILES)
    if not files:
        raise ValueError("the file is empty")
    names = _common_header(spark, files, encoding)
    rows = _read(spark, files, encoding, len(names))
    cells = [F.when(F.trim(F.col(f"c{i}")).isin(NA_TOKENS), None).otherwise(F.col(f"c{i}")).alias(f"c{i}")
             for i in range(len(names))]
    fields = rows.select(*cells, _bad(len(names)).alias("_bad"))
    good = fields.drop("_bad") if strict else fields.where("NOT _bad").drop("_bad")
    # one pass decides the types and counts the rows of another field count; all fields are read for that, as with
    # fewer the parser counts only those it needs
    wrong = F.count(F.when(F.col("_bad"), F.concat_ws("", *[f"c{i}" for i in range(len(names))]))).alias("wrong")
    table, facts = infer_types(good, [wrong] if strict else None, fields if strict else None)
    if strict and facts["wrong"]:
        raise ValueError(f"{facts['wrong']} rows do not have {len(names)} fields")
    if facts["rows"] == 0:
        raise ValueError("the file was parsed but has no data rows")
    out = unique_names(names)
    used = "/".join(sorted({encoding or SPARK_ENCODING[f["encoding"]] for f in files}))
    meta = spark.createDataFrame([(facts["rows"], len(names), sum(f["length"] for f in files), len(files), used)],
                                 "rows long, columns long, bytes long, files long, encoding string")
    return LoadResult(table.toDF(*out), meta)


def _bad(width: int):
    """Rows of another field count than the header. The schema has one spare field, so a right row is reported as
    one field short: its raw text is in ``_corrupt`` and its spare field is empty. What tells it from a row with
    fewer fields is the number of separators outside quotes."""
    bare = F.regexp_replace("_corrupt", r'"(?:[^"]++|"")*+"', "")
    fields = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return F.col("_extra").isNotNull() | (F.col("_corrupt").isNotNull() & (fields != width))


def _width(spark: SparkSession, files: list, encoding: str | None) -> int:
    return len(header(spark, files[0]["path"], encoding or SPARK_ENCODING[files[0]["encoding"]], files[0]["multi_line"]))


def ragged_rows(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """The raw text of the rows that do not have the header's number of fields."""
    files = bounded(_text_audit(spark, path), "files", MAX_FILES)
    if not files:
        raise ValueError("the file is empty")
    width = _width(spark, files, encoding)
    rows = _read(spark, files, encoding, width)
    every = F.char_length(F.concat_ws("", *[f"c{i}" for i in range(width)])) >= 0  # keeps all fields in the parse
    return rows.where(_bad(width) & every).select(F.coalesce("_corrupt", F.lit("")).alias("row"), "c0")


def check_structure(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[bool, str]:
    """The file parses with its header's column count, has at least one
    column and one data row. Rows with a different field count are reported."""
    files = bounded(_text_audit(spark, path), "files", MAX_FILES)
    if not files:
        return False, "the file is empty"
    try:
        width = _width(spark, files, encoding)
        df = _read(spark, files, encoding, width)
    except ValueError as e:
        return False, str(e)
    # all fields are read: with fewer the parser counts only those it needs
    bad = F.when(_bad(width), F.concat_ws("", *[f"c{i}" for i in range(width)]))
    r = df.agg(F.count(F.lit(1)).alias("n"), F.count(bad).alias("bad")).first()
    if r["n"] == 0:
        return False, "the file has no data rows"
    if r["bad"]:
        return False, f"{r['bad']} of {r['n']} rows do not have {width} fields"
    return True, ""
