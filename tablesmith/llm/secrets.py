"""Secret scans over an incremental blob ledger.

A document is a path, its text a blob named by the text's SHA-256. The ledger is
a Parquet folder with one row per blob and scan: the rule versions that were run
on the blob and the spans they found. ``scan`` runs only those (blob, rule
version) pairs that the ledger does not hold, so copies and unchanged texts are
never scanned twice, and a new rule version scans every blob for that rule only.
``findings`` joins the ledger back to all paths.

DataFrame expressions only. A scan first compares hashes with the ledger; texts move only
if a bitmap of the unseen blobs (``FILTER_BITS`` bits, whatever the number of blobs) may hold
them, and an exact join takes out the few others. The blobs are made distinct with a map-side pass, so
a text that a third of the rows share is sent once per task; the join back has
the paths on its left side, where adaptive execution splits a hot blob.

Defined results: a null text is the empty blob; a null id stays and gets the
findings of its text; repeated rows each get them; an empty table writes an empty
ledger; all other columns are ignored. Of scans that ran at the same time and entered a
pair twice, the spans count once. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import matches, scratch, stored, text_or_empty


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters.
    Change ``version`` with any change of the others."""
    kind: str
    version: int
    pattern: str
    group: int
    least: int

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: the first three are the base kinds; further rules add spans
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}+", 0, 16),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 1),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", 0, 1),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 0, 1),
)
BASE = ("assign", "access", "hex")
SPANS = "array<struct<rule:string,start:int,end:int>>"
FILTER_BITS = 1 << 26  # 8 MB, in rows of 4 KB
LEDGER = f"blob string, rules array<string>, spans {SPANS}"


def blob_id(column: str = "text") -> Column:
    return F.sha2(text_or_empty(column), 256)


def _spans(text: Column, rule: Rule) -> Column:
    part = (lambda m: m["match"]) if rule.group == 0 else (
        lambda m: F.regexp_extract(m["match"], rule.pattern, rule.group))
    good = F.filter(matches(text, rule.pattern), lambda m: F.char_length(part(m)) >= rule.least)
    return F.transform(good, lambda m: F.struct(
        F.lit(rule.key).alias("rule"), m["start"].alias("start"),
        (m["start"] + F.char_length(m["match"])).alias("end")))


def read_ledger(spark, ledger: str) -> DataFrame | None:
    try:
        return spark.read.schema(LEDGER).parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _number(blob: str = "blob") -> Column:
    """1 to FILTER_BITS: the bit of a blob."""
    return F.pmod(F.xxhash64(blob), F.lit(FILTER_BITS)) + 1


def maybe_in(texts: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows of ``texts`` whose blob may be one of ``blobs``: all that are, and of the others about one in
    FILTER_BITS / (number of blobs). The broadcast bitmap has at most FILTER_BITS bits."""
    n = _number()
    bitmap = blobs.groupBy(F.bitmap_bucket_number(n).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("_bits"))
    at = F.bitmap_bit_position(_number())
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = texts.join(F.broadcast(bitmap), F.bitmap_bucket_number(n) == F.col("_bucket"))
    return rows.where((F.floor(byte / F.pow(F.lit(2), at % 8)).cast("int") % 2) == 1).select(*texts.columns)


def unseen(docs: DataFrame, seen: DataFrame, wanted: Column) -> DataFrame:
    """(blob, rules): the blobs of ``docs`` with the wanted rules that the ledger does not hold for them. Hashes only."""
    blobs = docs.select(blob_id().alias("blob")).distinct()
    seen = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    return blobs.join(seen, "blob", "left").select("blob", F.array_except(
        wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("rules")).where(F.size("rules") > 0)


def scan(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger does not hold yet and append it to the ledger."""
    texts = docs.select(blob_id().alias("blob"), text_or_empty().alias("text"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    seen = read_ledger(docs.sparkSession, ledger)
    if seen is None:
        todo = texts.dropDuplicates(["blob"]).withColumn("rules", wanted)
    else:
        missing = stored(unseen(docs, seen, wanted), "unseen-blobs")
        todo = maybe_in(texts, missing).dropDuplicates(["blob"]).join(missing, "blob")
    found = [F.when(F.array_contains("rules", r.key), _spans(F.col("text"), r)).otherwise(F.array().cast(SPANS))
             for r in rules]
    todo.select("blob", "rules", F.flatten(F.array(*found)).cast(SPANS).alias("spans")).write.mode("append").parquet(
        ledger)


def findings(docs: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and spans (kind, start, end; by start, then rule order) of every
    path, from the ledger's entries of the given rules."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))])
    current = F.filter("spans", lambda s: s["rule"].isin([r.key for r in rules]))
    found = read_ledger(docs.sparkSession, ledger).select("blob", current.alias("spans")).where(
        F.size("spans") > 0).groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), F.element_at(order, s["rule"]).alias("ord"), s["end"].alias("end"),
        F.substring_index(s["rule"], "@", 1).alias("kind"))))
    found = found.select("blob", ordered.alias("spans"))
    return docs.select("doc_id", blob_id().alias("blob")).join(found, "blob", "left").select(
        "doc_id", "blob", F.transform(F.coalesce("spans", F.array().cast(
            "array<struct<start:int,ord:int,end:int,kind:string>>")), lambda s: F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    """Contract digest of a first scan of the whole of ``documents``: an empty
    ledger, so every blob is unseen."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ledger = scratch(spark, "secret-ledger")
    scan(docs, ledger)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return findings(docs, ledger).select(
        "doc_id", *[_count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def _duck(kind: str, pattern: str, group: int, least: int) -> str:
    part = "m" if group == 0 else f"regexp_extract(m, '{pattern}', {group})"
    return f"""
      SELECT text, '{kind}' AS kind, {[r.kind for r in RULES].index(kind)} AS ord, s - length(m) AS s, s AS e FROM (
        SELECT text, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
          list_sum(list_transform(ps[1:i], lambda x: length(x))) +
          list_sum(list_transform(ms[1:i], lambda x: length(x)))))::BIGINT AS s
        FROM (SELECT text, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps
              FROM texts) WHERE len(ms) > 0)
      WHERE length({part}) >= {least}"""


_CASELESS = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
                     for w in ("password", "passwd", "secret", "token", "api_?key"))
ORACLE = f"""
WITH texts AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
found AS ({" UNION ALL ".join(_duck(r.kind, {
    "assign": "(" + _CASELESS + r''')["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)''',
}.get(r.kind, r.pattern.replace("}+", "}")), r.group, r.least) for r in RULES)}),
digest AS (SELECT text,
  count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < 3), '') AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans FROM found GROUP BY text)
SELECT d.doc_id, coalesce(g.n_assign, 0) AS n_assign, coalesce(g.n_access, 0) AS n_access,
  coalesce(g.n_hex, 0) AS n_hex, sha256(coalesce(g.base, '')) AS base_sha256, coalesce(g.spans, '') AS spans
FROM documents d LEFT JOIN digest g ON coalesce(d.text, '') = g.text"""
