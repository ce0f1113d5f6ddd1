"""Records of CSV files whose quoted fields hold line ends, read by many tasks.

The text source already cuts a large file into byte ranges and hands out their lines. Whether
a line starts inside a quoted field depends on all lines before it, so the state is
found by a prefix scan over the ranges:

1. every range is run from both states (outside and inside quotes) at once, which gives
   one row per range: the state it ends in from either;
2. these rows, one per byte range, are chained per file on the driver, which gives the
   state every range really starts in and the range in which a record that runs over
   range ends began;
3. every range is run again from its state: records that lie inside come out whole, the
   pieces of a record that crosses range ends (at most two a range) are joined by a
   shuffle of the pieces alone.

A quote opens a field only at the field's start; a doubled quote inside a quoted field is a
quote. Lines end in a line feed, with or without a carriage return; a file in which a
carriage return stands elsewhere is reported by ``scan_ranges`` and left to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bounded
from ..session import cut_lineage

MAX_RANGES = 1_000_000


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a line that starts inside (or outside) a quoted field ends inside one."""
    at = 0
    if not inside:
        if line.startswith('"'):
            at = 1
        else:
            at = line.find(',"') + 2
            if at == 1:
                return False
    while True:  # inside quotes from ``at`` on
        quote = line.find('"', at)
        if quote < 0:
            return True
        if line.startswith('"', quote + 1):
            at = quote + 2
            continue
        at = line.find(',"', quote + 1) + 2
        if at == 1:
            return False


def _lines(spark: SparkSession, paths: list[str], charset: str) -> DataFrame:
    """(path, start, line) in file order inside each byte range; the range's first byte names it."""
    raw = F.col("value")
    text: Column = F.when(F.is_valid_utf8(raw), raw).otherwise(F.make_valid_utf8(raw)) if charset == "UTF-8" else F.decode(
        raw.cast("binary"), charset)
    return spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), text.alias("line"))


def scan_ranges(spark: SparkSession, paths: list[str], charset: str) -> list[dict]:
    """One row per byte range that holds a line start: path, start, the states it ends in from outside and from
    inside quotes (``from_out``, ``from_in``), whether a record begins in it if it starts inside quotes
    (``begins``), and whether a carriage return stands anywhere but before a line feed (``bare_cr``)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, row = None, None
        for batch in batches:
            done = []
            for path, start, line in zip(batch["path"], batch["start"], batch["line"], strict=True):
                if (path, start) != key:
                    if row is not None:
                        done.append((*key, *row))
                    key, row = (path, start), [False, True, False, False]
                row[2] = row[2] or not row[1]
                if '"' in line:
                    row[0], row[1] = ends_inside(line, row[0]), ends_inside(line, row[1])
                row[3] = row[3] or "\r" in line[:-1]
            yield pd.DataFrame(done, columns=["path", "start", "from_out", "from_in", "begins", "bare_cr"])
        if row is not None:
            yield pd.DataFrame([(*key, *row)], columns=["path", "start", "from_out", "from_in", "begins", "bare_cr"])

    found = _lines(spark, paths, charset).mapInPandas(
        run, "path string, start long, from_out boolean, from_in boolean, begins boolean, bare_cr boolean")
    return sorted((r.asDict() for r in bounded(found, "byte ranges", MAX_RANGES)), key=lambda r: (r["path"], r["start"]))


def chain(ranges: list[dict]) -> dict[tuple[str, int], tuple[bool, int]]:
    """(path, start) of a range -> whether it starts inside quotes, and the range in which the record that is open
    there began. A file that ends inside quotes is an error."""
    out: dict[tuple[str, int], tuple[bool, int]] = {}
    path, inside, owner = None, False, 0
    for r in [*ranges, None]:
        if r is None or r["path"] != path:
            if inside:
                raise ValueError(f"a quoted field is not closed in {path}")
            if r is None:
                break
            path, inside, owner = r["path"], False, r["start"]
        out[path, r["start"]] = inside, owner
        if not inside or r["begins"]:
            owner = r["start"]
        inside = r["from_in"] if inside else r["from_out"]
    return out


def records(spark: SparkSession, paths: list[str], charset: str, ranges: list[dict]) -> DataFrame:
    """(record): the text of every record but the header of each file and blank lines, cut off from the files'
    byte ranges by a checkpoint."""
    states = chain(ranges)
    first = {}
    for p, start in states:
        first.setdefault(p, start)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, inside, owner, open_, header = None, False, 0, [], False

        def piece(whole):
            return (key[0], owner, key[1], whole, header, "\n".join(open_))

        for batch in batches:
            out = []
            for path, start, line in zip(batch["path"], batch["start"], batch["line"], strict=True):
                if (path, start) != key:
                    if open_:
                        out.append(piece(False))
                    key, open_ = (path, start), []
                    if key not in states:
                        raise ValueError(f"the byte ranges of {path} have changed during the scan")
                    inside, owner = states[key]
                    cut, header = inside, first[path] == start
                if not inside and not open_:
                    owner = start
                    if line in ("", "\r"):
                        continue
                open_.append(line)
                if '"' in line:
                    inside = ends_inside(line, inside)
                if not inside:
                    # a record that came over from the range before is a piece, even when it ends here
                    out.append(piece(not cut))
                    open_, cut, header = [], False, False
            yield pd.DataFrame(out, columns=["path", "owner", "at", "whole", "header", "record"])
        if open_:
            yield pd.DataFrame([piece(False)], columns=["path", "owner", "at", "whole", "header", "record"])

    found = cut_lineage(_lines(spark, paths, charset).mapInPandas(
        run, "path string, owner long, at long, whole boolean, header boolean, record string"))
    crossing = found.where("NOT whole").groupBy("path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("at", "header", "record"))).alias("p")).select(
        F.element_at("p", 1)["header"].alias("header"), F.concat_ws("\n", F.transform("p", lambda x: x["record"])).alias("record"))
    every = found.where("whole").select("header", "record").unionByName(crossing)
    return every.where("NOT header").select(F.regexp_replace("record", r"\r$", "").alias("record"))
