"""Language identification by interpolated Kneser-Ney character models.

A text is lower-cased and everything but letters becomes a single boundary sign.
For each language the counts of all 4-grams of its training texts give one
interpolated Kneser-Ney model: discounted counts at the top, continuation counts
below, the uniform distribution at the end. The model is stored as sorted arrays
of 64-bit n-gram hashes, one per order, with a column of log-probabilities per
language; a 4-gram packs four 16-bit code points, so the hash is free of
collisions. Scoring is a binary search per character, and per order only for the
n-grams that the order above does not hold. The language with the lowest
cross-entropy per character wins.

Training counts cover every training text. They are made per task, summed by the
hash over the cluster, and all of them make the model. Up to ``MAX_NGRAMS`` counts it
is built on the driver and broadcast (``Model``). Beyond that nothing goes: the counts
stay in the shared folder, joins on the grams build the same probabilities for the
4-grams that occur, and texts are scored in blocks, each against the probabilities of
its own 4-grams (``SpreadModel``). More than ``MAX_LANGUAGES`` languages raise an error.

Rejection and confidence are calibrated on the training documents after scoring:
a document is rejected if its cross-entropy is above ``SLACK`` times the
``QUANTILE`` of its language, and the score is the share of the winner in a softmax
whose temperature fits the training labels best.

Defined results: a null text or one without a letter is ``und`` with score 0, and
rejected; without training documents every document is so; documents with null
lang are scored, not learnt from; a null id counts as the text "" in the fold; an
empty table gives an empty result; other columns are ignored (``keep_known`` keeps
them).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import small_batches, stored

ORDER = 4
#: counts up to which the model is one broadcast; larger ones are joined
MAX_NGRAMS = 2_000_000
MAX_LANGUAGES = 200
QUANTILE = 0.999
SLACK = 1.5
#: softmax sharpness in nats per character, fitted on the training documents
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0)
CHARS_AT_ONCE = 1 << 18
#: a block of texts ends at so many signs or distinct 4-grams
BLOCK_SIGNS = 1 << 22
BLOCK_GRAMS = 1 << 18
BOUNDARY = 32
_LETTERS: list[np.ndarray] = []


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def symbols(text: str) -> np.ndarray:
    """16-bit signs of a text: letters, BOUNDARY for runs of anything else, three of them in front, one behind.
    Empty if there is no letter."""
    if not _LETTERS:
        _LETTERS.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", errors="replace"), dtype="<u4")
    letter = _LETTERS[0][c]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    c = np.where(letter, np.minimum(c, 0xFFFF), BOUNDARY)
    c = c[letter | np.concatenate(([False], letter[:-1]))]
    return np.concatenate(([BOUNDARY] * 3, c, [BOUNDARY] if letter[-1] else [])).astype(np.uint64)


def grams(s: np.ndarray) -> np.ndarray:
    """The 4-grams of a sign array, packed."""
    if len(s) < ORDER:
        return np.zeros(0, dtype=np.uint64)
    g = s[:-3] << np.uint64(48)
    for k in (1, 2, 3):
        g |= s[k:len(s) - 3 + k] << np.uint64(16 * (3 - k))
    return g


def _pieces(texts) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the text, 4-grams) in pieces of at most CHARS_AT_ONCE signs."""
    for i, text in enumerate(texts):
        s = symbols(text) if text else np.zeros(0, dtype=np.uint64)
        for at in range(0, max(0, len(s) - 3), CHARS_AT_ONCE):
            yield i, grams(s[at:at + CHARS_AT_ONCE + 3])


def _batches(texts) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, 4-grams) of about CHARS_AT_ONCE signs."""
    held, places, n = [], [], 0
    for i, g in _pieces(texts):
        held.append(g)
        places.append(np.full(len(g), i))
        n += len(g)
        if n >= CHARS_AT_ONCE:
            yield np.concatenate(places), np.concatenate(held)
            held, places, n = [], [], 0
    if held:
        yield np.concatenate(places), np.concatenate(held)


def count_grams(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of ``docs`` (lang, text)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                for _, g in _batches(part["text"]):
                    gram, n = np.unique(g, return_counts=True)
                    if lang in found:
                        both = np.concatenate((found[lang][0], gram))
                        gram, of = np.unique(both, return_inverse=True)
                        n = np.bincount(of, weights=np.concatenate((found[lang][1], n))).astype(np.int64)
                    found[lang] = gram, n
            if sum(len(g) for g, _ in found.values()) > MAX_NGRAMS:  # bounds the task's memory
                yield from _rows(found)
                found = {}
        yield from _rows(found)

    small_batches(docs.sparkSession)
    return docs.mapInPandas(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _rows(found: dict) -> Iterator[pd.DataFrame]:
    for lang, (gram, n) in found.items():
        yield pd.DataFrame({"lang": lang, "gram": gram.view(np.int64), "n": n.astype(np.int64)})


class Model:
    """Arrays of the interpolated models of all languages.

    grams[k], logp[k]: sorted (k+1)-gram hashes and their log-probabilities, a
    column per language. contexts[k], backoff[k]: sorted k-gram contexts and the
    log-weight that goes to the order below."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray):
        self.langs = langs
        size = len(langs)
        self.grams, self.logp = [np.zeros(0, np.uint64)] * ORDER, [np.zeros((0, size))] * ORDER
        self.contexts, self.backoff = [np.zeros(0, np.uint64)] * ORDER, [np.zeros((0, size))] * ORDER
        levels = [None] * ORDER  # (union of grams, counts by language) of each order
        union, of = np.unique(gram, return_inverse=True)
        c = np.zeros((len(union), size))
        np.add.at(c, (of, lang), n)
        levels[ORDER - 1] = union, c
        for k in range(ORDER - 2, -1, -1):  # continuation counts: how many signs go before
            union, c = levels[k + 1]
            low, of = np.unique(union & np.uint64((1 << 16 * (k + 1)) - 1), return_inverse=True)
            below = np.zeros((len(low), size))
            np.add.at(below, of, c > 0)
            levels[k] = low, below
        self.floor = np.log(1.0 / (len(levels[0][0]) + 1))
        lower = np.full((1, size), 1.0 / (len(levels[0][0]) + 1))
        for k in range(ORDER):
            union, c = levels[k]
            context, of = np.unique(union >> np.uint64(16), return_inverse=True) if k else (
                np.zeros(1, np.uint64), np.zeros(len(union), np.int64))
            once, twice = (c == 1).sum(0), (c == 2).sum(0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5)
            discount = np.clip(discount, 0.05, 0.95)
            total, kinds = np.zeros((len(context), size)), np.zeros((len(context), size))
            np.add.at(total, of, c)
            np.add.at(kinds, of, c > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            if k:
                below = lower[np.searchsorted(levels[k - 1][0], union & np.uint64((1 << 16 * k) - 1))]
            else:
                below = np.repeat(lower, len(union), axis=0)
            own = np.where(total[of] > 0, np.maximum(c - discount, 0) / np.maximum(total[of], 1), 0.0)
            lower = own + weight[of] * below
            self.grams[k], self.logp[k] = union, np.log(lower).astype(np.float32)
            self.contexts[k], self.backoff[k] = context, np.log(weight).astype(np.float32)

    def logprob(self, g: np.ndarray) -> np.ndarray:
        """Log-probability of the last sign of each 4-gram, a column per language."""
        return self._order(g, ORDER - 1)

    def _order(self, g: np.ndarray, k: int) -> np.ndarray:
        if k < 0:
            return np.full((len(g), len(self.langs)), self.floor, dtype=np.float32)
        at = np.minimum(np.searchsorted(self.grams[k], g), max(0, len(self.grams[k]) - 1))
        known = self.grams[k][at] == g if len(self.grams[k]) else np.zeros(len(g), bool)
        if known.all():
            return self.logp[k][at]
        out = np.empty((len(g), len(self.langs)), dtype=np.float32)
        out[known] = self.logp[k][at[known]]
        rest = g[~known]
        low = self._order(rest & np.uint64((1 << 16 * k) - 1) if k else rest, k - 1)
        context = rest >> np.uint64(16) if k else np.zeros(len(rest), np.uint64)
        if len(self.contexts[k]):
            at = np.minimum(np.searchsorted(self.contexts[k], context), len(self.contexts[k]) - 1)
            low = low + np.where((self.contexts[k][at] == context)[:, None], self.backoff[k][at], 0)
        out[~known] = low
        return out

    def cross_entropies(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(signs of each text, summed negative log-probability, a column per language)."""
        return _entropies(texts, self.logprob, len(self.langs))


def _entropies(texts, logprob, size: int) -> tuple[np.ndarray, np.ndarray]:
    n, total = np.zeros(len(texts), np.int64), np.zeros((len(texts), size))
    for place, g in _batches(texts):
        lp = logprob(g)
        starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        n[place[starts]] += np.diff(np.append(starts, len(place)))
        for j in range(size):
            total[place[starts], j] -= np.add.reduceat(lp[:, j], starts, dtype=np.float64)
    return n, total


class SpreadModel:
    """The models of all languages as tables: ``counts`` (lang, gram, n) in the shared folder, all of them."""

    def __init__(self, langs: list[str], counts: DataFrame):
        self.langs = langs
        place = F.create_map(*[x for i, name in enumerate(langs) for x in (F.lit(name), F.lit(i))])
        self.counts = counts.select(F.element_at(place, F.col("lang")).alias("j"), F.col("gram").alias("g"),
                                    F.col("n").alias("c"))

    def _dense(self, rows: DataFrame, key: str, **values: str) -> DataFrame:
        """``key`` and an array by language of each of ``values`` (0 where a language has none)."""
        return rows.groupBy(key).agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("j") == j, F.col(c))), F.lit(0)).cast(
            "double") for j in range(len(self.langs))]).alias(name) for name, c in values.items()])

    def logprobs(self, wanted: DataFrame) -> DataFrame:
        """(g, lp): the log-probabilities of the last sign of each distinct 4-gram of ``wanted`` (g), by language."""
        def low(k):
            return F.col("g").bitwiseAND(F.lit((1 << 16 * k) - 1))
        counts, asked = [self.counts], [wanted]  # from the top order down
        for k in range(ORDER - 1, 0, -1):  # continuation counts: how many signs go before
            counts.append(stored(counts[-1].groupBy("j", low(k).alias("g")).agg(F.count("*").alias("c")),
                                 "langid-counts"))
            asked.append(stored(asked[-1].select(low(k).alias("g")).distinct(), "langid-asked"))
        floor = 1.0 / (counts[-1].select("g").distinct().count() + 1)
        below = None
        for k in range(ORDER):  # signs before the last
            c, q = counts[ORDER - 1 - k], asked[ORDER - 1 - k]
            discount = [0.5] * len(self.langs)
            for r in c.groupBy("j").agg(*[F.sum((F.col("c") == x).cast("long")).alias(f"n{x}") for x in (1, 2)]).collect():
                if r["n1"]:  # a row per language
                    discount[r["j"]] = min(0.95, max(0.05, r["n1"] / (r["n1"] + 2 * r["n2"])))
            d = F.array(*[F.lit(x) for x in discount])
            before = F.shiftrightunsigned("g", 16)
            context = self._dense(c.groupBy("j", before.alias("b")).agg(F.sum("c").alias("total"), F.count("*").alias(
                "kinds")), "b", total="total", kinds="kinds")
            rows = q.withColumn("b", before).join(self._dense(c, "g", c="c"), "g", "left").join(context, "b", "left")
            if k:
                rows = rows.withColumn("s", low(k)).join(below.select(F.col("g").alias("s"), F.col("p").alias("lower")), "s")
            else:
                rows = rows.withColumn("lower", F.array(*[F.lit(floor)] * len(self.langs)))
            none = F.array(*[F.lit(0.0)] * len(self.langs))
            rows = rows.withColumns({x: F.coalesce(F.col(x), none) for x in ("c", "total", "kinds")})
            p = F.transform("lower", lambda p, j: F.when(F.get("total", j) > 0, (F.greatest(F.lit(0.0), F.get(
                "c", j) - F.get(d, j)) + F.get(d, j) * F.get("kinds", j) * p) / F.get("total", j)).otherwise(p))
            below = stored(rows.select("g", p.alias("p")), "langid-order")
        return below.select("g", F.transform("p", lambda p: F.log(p).cast("float")).alias("lp"))

    def entropies(self, texts: DataFrame) -> DataFrame:
        """(row, signs, ce) of ``texts`` (row, text), row being unique. A 4-gram is joined once for a block of texts,
        not once for a text, so a frequent one meets few rows."""
        size = len(self.langs)

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Rows of texts with their block (its first row); at a block's end one row (-1) with its 4-grams."""
            block, signs, found, loose = None, 0, [], 0
            def end(out):
                gram = np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)
                out.append((block, -1, None, gram.view(np.int64)))
            for batch in batches:
                out = []
                for row, text in zip(batch["row"].tolist(), batch["text"].tolist(), strict=True):
                    block = row if block is None else block
                    out.append((block, row, text, None))
                    for _, g in _pieces([text]):
                        found.append(np.unique(g))
                        signs, loose = signs + len(g), loose + len(found[-1])
                    if loose > CHARS_AT_ONCE:
                        found, loose = [np.unique(np.concatenate(found))], 0
                    if signs >= BLOCK_SIGNS or found and len(found[0]) >= BLOCK_GRAMS:
                        end(out)
                        block, signs, found, loose = None, 0, [], 0
                yield pd.DataFrame(out, columns=["block", "row", "text", "grams"])
            if block is not None:
                out = []
                end(out)
                yield pd.DataFrame(out, columns=["block", "row", "text", "grams"])

        def judged(own: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(model["g"].to_numpy().astype(np.int64).view(np.uint64))
            g = model["g"].to_numpy().astype(np.int64).view(np.uint64)[order]
            lp = np.stack(model["lp"].to_numpy()[order]) if len(g) else np.zeros((0, size), np.float32)
            n, total = _entropies(own["text"].tolist(), lambda x: lp[np.searchsorted(g, x)], size)
            return pd.DataFrame({"row": own["row"], "signs": n, "ce": list(total / np.maximum(n, 1)[:, None])})

        small_batches(texts.sparkSession)
        blocks = stored(texts.mapInPandas(cut, "block long, row long, text string, grams array<long>"), "langid-blocks")
        wanted = stored(blocks.where("row < 0").select("block", F.explode("grams").alias("g")), "langid-wanted")
        logprobs = self.logprobs(stored(wanted.select("g").distinct(), "langid-asked"))
        return blocks.where("row >= 0").select("block", "row", "text").groupBy("block").cogroup(
            wanted.join(logprobs, "g").groupBy("block")).applyInPandas(judged, "row long, signs long, ce array<double>")


def train(docs: DataFrame) -> Model | SpreadModel | None:
    """The model of all documents that are not held out and have a lang; None if there are none."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select(
        F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = stored(count_grams(rows), "langid-counts")
    langs = sorted(r[0] for r in counts.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not langs:
        return None
    if counts.count() > MAX_NGRAMS:
        return SpreadModel(langs, counts)
    rows = counts.toPandas()  # at most MAX_NGRAMS rows
    lang = np.searchsorted(langs, rows["lang"].to_numpy().astype(str))
    return Model(langs, lang, rows["gram"].to_numpy().view(np.uint64), rows["n"].to_numpy())


def score(docs: DataFrame, model: Model | SpreadModel, keep: list[str]) -> DataFrame:
    """``keep`` columns, _l_signs and _l_ce (cross-entropy per sign, by language in the model's order)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    if isinstance(model, SpreadModel):
        rows = stored(docs.select(*[F.col(f"`{c}`") for c in keep], text.alias("_l_text"),
                                  F.monotonically_increasing_id().alias("_l_row")), "langid-rows")
        found = model.entropies(rows.select(F.col("_l_row").alias("row"), F.col("_l_text").alias("text")))
        return rows.join(found.select(F.col("row").alias("_l_row"), F.col("signs").alias("_l_signs"), F.col("ce").alias(
            "_l_ce")), "_l_row").select(*[F.col(f"`{c}`") for c in keep], "_l_signs", "_l_ce")
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_NGRAMS 4-grams at most

    @F.pandas_udf("signs long, ce array<double>")
    def entropies(texts: pd.Series) -> pd.DataFrame:
        n, total = shared.value.cross_entropies(texts.tolist())
        return pd.DataFrame({"signs": n, "ce": list(total / np.maximum(n, 1)[:, None])})

    out = docs.withColumn("_l_e", entropies(text))
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("_l_e.signs").alias("_l_signs"),
                      F.col("_l_e.ce").alias("_l_ce"))


def _confidence(ce: Column, sharpness: float) -> Column:
    """Share of the lowest cross-entropy in the softmax."""
    low = F.array_min(ce)
    return 1 / F.aggregate(ce, F.lit(0.0), lambda acc, x: acc + F.exp(F.greatest(F.lit(-700.0), sharpness * (low - x))))


def _identified(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns (doc_id and lang among them) and _l_pred, _l_score, _l_rejected, _l_entropy of every row."""
    model = train(docs)
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in keep], F.lit("und").alias("_l_pred"),
                           F.lit(0.0).alias("_l_score"), F.lit(True).alias("_l_rejected"),
                           F.lit(None).cast("double").alias("_l_entropy"))
    rows = stored(score(docs, model, keep), "langid-scores")
    ce, best, empty = F.col("_l_ce"), F.array_min("_l_ce"), F.col("_l_signs") == 0
    learnt = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & ~empty)
    place = F.create_map(*[x for i, name in enumerate(model.langs) for x in (F.lit(name), F.lit(i))])
    gold = F.get(ce, F.element_at(place, F.col("lang").cast("string")))
    losses = [F.avg(-F.log(F.greatest(F.lit(1e-12), _confidence(ce, s) * F.exp(
        F.greatest(F.lit(-700.0), s * (best - gold)))))) for s in SHARPNESS]
    fitted = [x if x is not None else 0.0 for x in learnt.agg(*losses).first()]
    sharpness = SHARPNESS[fitted.index(min(fitted))]
    limits = {r["l"]: r["q"] for r in learnt.groupBy(F.col("lang").cast("string").alias("l")).agg(
        F.percentile_approx(gold, QUANTILE, 10_000).alias("q")).collect()}  # a row per language of the model
    limit = F.array(*[F.lit(limits.get(name, float("inf")) * SLACK).cast("double") for name in model.langs])
    winner = (F.array_position(ce, best) - 1).cast("int")
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        F.when(empty, "und").otherwise(F.get(F.array(*[F.lit(x) for x in model.langs]), winner)).alias("_l_pred"),
        F.when(empty, 0.0).otherwise(_confidence(ce, sharpness)).alias("_l_score"),
        (empty | (best > F.get(limit, winner))).alias("_l_rejected"), F.when(~empty, best).alias("_l_entropy"))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected and cross_entropy, one row per document."""
    return _identified(docs, ["doc_id", "lang"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_l_pred").alias("lang_pred"),
        F.col("_l_score").alias("score"), F.col("_l_rejected").alias("rejected"),
        F.col("_l_entropy").alias("cross_entropy"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that are not rejected, with the columns of ``docs``."""
    return _identified(docs, docs.columns).where("NOT _l_rejected").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Contract digest of ``identify`` on the whole of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score", "rejected")
