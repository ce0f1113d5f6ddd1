"""Quality rules by weak supervision.

Rules on counts of a text vote good or bad or abstain; expectation-maximisation
over all documents (``weak.fit``) estimates how far each rule is to be trusted,
and the posterior probability that a document is good replaces a filter that all
rules must pass. DataFrame expressions only; the texts are read once, and votes
and counts go to the shared folder.

Repeated 3-word windows are found by sorting 64-bit window hashes with their
positions, so a long text costs n log n.

Defined results: a null text has no words, fails the base rule and is not kept;
repeated rows count each; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm import weak
from tablesmith.llm.common import let, stored, text_or_empty, words

MIN_WORDS = 50
KEEP_FROM = 0.5


def _repeat_words(ws: Column) -> Column:
    """Words inside 3-word windows that occur twice or more."""
    def from_hashes(h):
        def from_sorted(pairs):
            same = F.transform(pairs, lambda x, j: F.when(
                (x["g"] == F.get(pairs, j - 1)["g"]) | (x["g"] == F.get(pairs, j + 1)["g"]), x["p"]))
            return let(F.sort_array(F.filter(same, lambda p: p.isNotNull())), lambda at: F.aggregate(
                F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))),
                F.lit(0).cast("long"), lambda acc, x: acc + x))
        pairs = F.sort_array(F.transform(h, lambda g, p: F.struct(g.alias("g"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(pairs, from_sorted))
    hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(
        F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
    return F.when(F.size(ws) < 4, F.lit(0).cast("long")).otherwise(let(hashes, from_hashes))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at."""
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = let(lines, lambda a: F.struct(F.size(a).alias("n"), (F.size(a) - F.size(F.array_distinct(a))).alias("dup")))
    of_words = let(words(t), lambda a: F.struct(
        F.size(a).alias("n"), F.char_length(F.array_join(a, "")).alias("chars"), _repeat_words(a).alias("rep")))
    rows = docs.select("doc_id", text_or_empty().alias("_t")).select(
        "doc_id", of_words.alias("w"), of_lines.alias("l"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"[#*$%&|<>]", ""))).alias("symbols"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{L}+", ""))).alias("letters"),
        (F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}+", ""))).alias("capitals"))
    return rows.select(
        "doc_id", F.col("w.n").cast("long").alias("n_words"), F.col("w.chars").cast("long").alias("word_chars"),
        F.col("symbols").cast("long").alias("n_symbols"), F.col("l.n").cast("long").alias("n_lines"),
        F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.rep").alias("n_repeat_words"),
        F.col("letters").cast("long").alias("n_letters"), F.col("capitals").cast("long").alias("n_capitals"))


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def votes() -> list[Column]:
    """The rules: size, word length, symbols, repeated lines, repeated windows, letters, capitals."""
    mean, symbols = _share("word_chars", "n_words"), _share("n_symbols", "n_words")
    lines, repeats = _share("n_dup_lines", "n_lines"), _share("n_repeat_words", "n_words")
    letters, capitals = _share("n_letters", "word_chars"), _share("n_capitals", "n_letters")
    return [
        _vote(F.col("n_words") >= 80, F.col("n_words") < MIN_WORDS),
        _vote(mean.between(3, 10), (mean < 2) | (mean > 15)),
        _vote(symbols <= 0.05, symbols > 0.25),
        _vote(lines <= 0.1, lines > 0.3),
        _vote(repeats <= 0.25, repeats > 0.5),
        _vote(letters >= 0.85, letters < 0.65),
        _vote(capitals <= 0.25, capitals > 0.6),
    ]


def judge(docs: DataFrame) -> DataFrame:
    """``counts`` with base_failed, quality (the posterior) and kept."""
    rules = votes()
    rows = stored(counts(docs).withColumn("votes", F.array(*rules)), "quality-counts")
    model = weak.fit(rows.select("votes"), len(rules))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    quality = model.posterior(F.col("votes"))
    return rows.withColumn("base_failed", failed).withColumn("quality", quality).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_FROM)).drop("votes")


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``judge`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                              "base_failed", "kept", "quality")
