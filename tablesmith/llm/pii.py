"""Personal data by bootstrapped contextual extraction.

Seeds are the entities that fixed expressions and checks find (e-mail, IP, card,
phone). The two words before an entity are a lexical pattern. Patterns and the
instances they stand before make a bipartite graph over the whole corpus: besides
the seeds, every token with a digit outside the seeds is an instance. Spark scores
the graph in rounds: a pattern's confidence is the score it gathers from its
distinct instances over their number plus one, and an instance that is no seed
takes the noisy-or of its confident patterns. After the last round, unseen
identifiers behind confident patterns become spans of kind ``ctx``. Seeds always
stay.

DataFrame expressions only. One scan of the texts writes spans and candidates to
the shared folder, and everything later reads that. Texts are made distinct by
their SHA-256 before the graph, so copies neither weigh more nor meet in one task.

Defined results: a null text counts as empty; the findings belong to the text, so
null ids and repeated rows get those of their text; an entity whose two words
before are not within 80 characters, or reach back to another candidate, is no
pattern; an empty table gives an empty result; other columns are ignored
(``redact`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablesmith.llm.common import SPACE, let, matches, stored, text_or_empty

#: ``(?:\\G|(?<!c))`` lets a match start only where a run of c starts or the last match ended, as an
#: unanchored search does, without trying every position of a long run; possessive groups do not recurse
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
IP_PARTS = r"^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])){3}$"
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
KINDS = ("email", "ip", "card", "phone", "ctx")
SPAN = "array<struct<ord:int,start:int,end:int>>"
FOUND = "array<struct<ord:int,start:int,end:int,instance:string,pattern:string>>"

ROUNDS = 3
CONFIDENT = 0.7
MIN_INSTANCES = 3
CONTEXT = 80


def text_key(column: str = "text") -> Column:
    return F.sha2(text_or_empty(column), 256)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int") * (F.lit(2) - i % 2)
        return F.when(d > 9, d - 9).otherwise(d)
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.char_length(digits)), value), F.lit(0),
                       lambda a, v: a + v) % 10 == 0


def _good(kind: str, m: Column) -> Column:
    if kind == "ip":
        return m.rlike(IP_PARTS)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.char_length(d).between(13, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.char_length(_digits(m)).between(9, 15)
    return F.lit(True)


def _pattern(before: Column) -> Column:
    """The last two words of the text before, in lower case, without marks; null if there are not two."""
    last = F.slice(F.concat(F.array(F.lit(""), F.lit("")), F.filter(
        F.split(F.lower(F.right(before, F.lit(CONTEXT))), SPACE), lambda w: w != "")), -2, 2)
    bare = F.transform(last, lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return let(bare, lambda p: F.when((p[0] != "") & (p[1] != ""), F.concat_ws(" ", p[0], p[1])))


def _entities(text: Column, order: int, pattern: str, good) -> Column:
    return F.transform(F.filter(matches(text, pattern), lambda x: good(x["match"])), lambda x: F.struct(
        F.lit(order).alias("ord"), x["start"].alias("start"),
        (x["start"] + F.char_length(x["match"])).alias("end"), F.lower(x["match"]).alias("instance"),
        _pattern(x["before"]).alias("pattern"))).cast(FOUND)


def _scan(docs: DataFrame) -> DataFrame:
    """(key, found): base entities and candidates of each distinct text that has any."""
    text = F.col("t")
    base = [_entities(text, i, p, lambda m, k=k: _good(k, m))
            for i, (k, p) in enumerate(zip(KINDS, (EMAIL, IP, CARD, PHONE), strict=False))]
    every = F.flatten(F.array(*base, _entities(text, 4, CANDIDATE, lambda m: F.lit(True))))
    rows = docs.select(text_key().alias("key"), text_or_empty().alias("t")).select("key", every.alias("found"))
    return stored(rows.where(F.size("found") > 0).dropDuplicates(["key"]), "pii-texts")


def _candidates(texts: DataFrame) -> DataFrame:
    """(key, start, end, instance, pattern) of candidates that overlap no base entity."""
    rows = texts.select("key", F.inline("found"))
    w = Window.partitionBy("key").orderBy("start", F.desc("ord"))
    reach = F.max(F.when(F.col("ord") < 4, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # rows after this one are rows before it in the reverse order: a running minimum, linear in a text's entities
    back = Window.partitionBy("key").orderBy(F.desc("start"), "ord")
    ahead = F.min(F.when(F.col("ord") < 4, F.col("start"))).over(back.rowsBetween(Window.unboundedPreceding, -1))
    same = F.max(F.when(F.col("ord") < 4, F.col("end"))).over(Window.partitionBy("key", "start"))
    return rows.select("*", reach.alias("reach"), ahead.alias("ahead"), same.alias("same")).where(
        (F.col("ord") == 4) & F.col("pattern").isNotNull() & F.col("same").isNull()
        & (F.coalesce("reach", F.lit(-1)) <= F.col("start"))
        & (F.coalesce("ahead", F.col("end")) >= F.col("end"))).select("key", "start", "end", "instance", "pattern")


def confident_patterns(graph: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(p, confidence) from the distinct edges (p, i, seed)."""
    graph = stored(graph.withColumn("score", F.col("seed").cast("double")), "pii-graph")
    for n in range(rounds):
        patterns = graph.groupBy("p").agg(
            (F.sum("score") / (F.count("*") + 1)).alias("confidence"),
            F.sum((F.col("score") >= CONFIDENT).cast("int")).alias("support")).where(
            (F.col("confidence") >= CONFIDENT) & (F.col("support") >= MIN_INSTANCES)).select("p", "confidence")
        if n + 1 == rounds:
            return patterns
        patterns = stored(patterns, "pii-patterns")
        scored = graph.where("NOT seed").join(patterns, "p").groupBy("i").agg(
            (1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("new"))
        graph = stored(graph.join(scored, "i", "left").select("p", "i", "seed", F.when(
            F.col("seed"), 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")), "pii-graph")


def find(docs: DataFrame) -> DataFrame:
    """(key, spans) of each distinct text with personal data; spans are (ord, start,
    end), ord being the place of the kind in KINDS, ordered by kind, then start."""
    texts = _scan(docs)
    seeds = texts.select("key", F.inline("found")).where("ord < 4 AND pattern IS NOT NULL")
    loose = stored(_candidates(texts), "pii-candidates")
    graph = seeds.select("pattern", "instance", F.lit(True).alias("seed")).union(
        loose.select("pattern", "instance", F.lit(False))).groupBy(
        F.xxhash64("pattern").alias("p"), F.xxhash64("instance").alias("i")).agg(F.max("seed").alias("seed"))
    patterns = confident_patterns(graph)
    more = loose.withColumn("p", F.xxhash64("pattern")).join(patterns, "p").groupBy("key").agg(
        F.collect_list(F.struct(F.lit(4).alias("ord"), "start", "end")).alias("more"))
    base = F.transform(F.filter("found", lambda x: x["ord"] < 4), lambda x: F.struct(
        x["ord"].alias("ord"), x["start"].alias("start"), x["end"].alias("end")))
    spans = F.sort_array(F.concat(base.cast(SPAN), F.coalesce(F.col("more").cast(SPAN), F.array().cast(SPAN))))
    return stored(texts.join(more, "key", "left").select("key", spans.alias("spans")).where(F.size("spans") > 0),
                  "pii-spans")


def _span_text(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["ord"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets and n_chars, if there is one, set anew. Spans that
    overlap are replaced as one, from the first start to the greatest end, by the kind of the first."""
    spans = find(docs).select(F.col("key").alias("_p_key"), F.col("spans").alias("_p_spans"))
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    by_start = F.sort_array(F.transform("_p_spans", lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"), s["ord"].alias("ord"))))
    spot = "array<struct<start:int,end:int,ord:int>>"
    def joined(acc, s):
        last, end = F.get(acc, F.size(acc) - 1), -s["back"]
        return F.when(s["start"] >= F.coalesce(last["end"], F.lit(0)), F.concat(acc, F.array(F.struct(
            s["start"].alias("start"), end.alias("end"), s["ord"].alias("ord"))))).when(
            end <= last["end"], acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                last["start"].alias("start"), end.alias("end"), last["ord"].alias("ord")))))
    apart = F.aggregate(by_start, F.array().cast(spot), lambda acc, s: joined(acc, s).cast(spot))
    def rebuilt(a):
        def piece(x, i):
            at = F.coalesce(F.get(a, i - 1)["end"], F.lit(0))
            return F.concat(F.substring("text", at + 1, x["start"] - at), F.get(marks, x["ord"]))
        last = F.get(a, F.size(a) - 1)["end"]
        return F.concat(F.array_join(F.transform(a, piece), ""), F.substring("text", last + 1, F.char_length("text")))
    new = F.when(F.col("_p_spans").isNull(), F.col("text")).otherwise(let(apart, rebuilt))
    # the spans grow with the data: always the shuffled join, in which adaptive execution splits a hot text
    rows = docs.withColumn("_p_row", text_key()).join(
        spans.hint("merge"), F.col("_p_row") == F.col("_p_key"), "left").withColumn("text", new)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns])


def _count(order: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long")


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``find`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select("doc_id", text_key().alias("key")).join(find(docs), "key", "left").withColumn(
        "spans", F.coalesce("spans", F.array().cast(SPAN)))
    base = F.filter("spans", lambda s: s["ord"] < 4)
    return rows.select(
        "doc_id", *[_count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"))
