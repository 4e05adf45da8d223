"""Toxic passages as maximum-scoring segments of token log-odds, and a document score from extreme-value statistics.

Fit, on a bounded sample of labelled rows: the log-odds of a token between toxic and other documents, with an informative
Dirichlet prior from both, by the documents that hold it. Copies of a text count as one: a row weighs 1 over the number of
rows that share one of its COPY_KEYS minhashes, else the rare words of a toxic text with many near copies would pass for toxic
words. Tokens of either sign are kept where the log-odds is significant (MIN_Z) and of size (MIN_ODDS), so that the words of a
language or a subject with more toxic documents than others aren't. All other tokens cost a drift: DRIFT, or twice what the
kept tokens give to the mean clean document, so that a clean document's walk falls.

The scores of a text's tokens form a walk; one linear scan finds all of its maximal-scoring segments (passages). Among
documents that aren't toxic, a text's best segment follows an extreme-value law, P(best > x) = 1 - exp(-K n exp(-lambda x)):
lambda solves E exp(lambda s) = 1 for their token scores and K is fitted to their best segments. A logistic function, fitted to
the same rows, turns the significance of the best passage and the number of significant passages into a score from 0 to 1.

Apply: one pass over all documents and their whole texts, without a shuffle. The model is a bounded list of tokens.

Nulls and edge cases: a null, empty or blank text has no passage and gets the score of a text without any. Labels that
are null are ignored; a document with repeated labels counts once, as toxic if any says so. Documents with a null id are
scored but never trained on, and held_out is false. Without any toxic or any other training row all scores are 0. An
empty table gives an empty result. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import hashing
from .common import written

#: Labelled rows that the model is fitted to, at most: those of the smallest hashes of doc_id.
MAX_TRAIN = 40_000
MIN_Z, MIN_ODDS, TOP_WEIGHT, DRIFT = 2.5, 1.5, 8.0, 0.05
#: Minhashes by which copies are known, and the weight of a row without copies.
COPY_KEYS, ONE = 4, 1 << 20
#: Documents' worth of prior evidence.
PRIOR = 500.0
#: A passage is significant if so many of its score or better are expected in a clean text of the same length.
SIGNIFICANT = 0.05
FOLDS = 5
#: The score of a text without any passage, at most, however many of the training rows are toxic.
NOTHING = 0.49

MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_/\\"


def tokens(text: str | None) -> list[str]:
    return [w.strip(MARKS) for w in text.lower().split()] if text else []


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    drift: float = DRIFT
    rate: float = 1.0  # lambda
    log_k: float = 0.0
    logistic: tuple[float, float, float] | None = None

    def passages(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of tokens, and (first token, token after the last, score) of each maximal-scoring segment."""
        words = tokens(text)
        get = self.weights.get
        hits = [(i, s) for i, w in enumerate(words) if (s := get(w)) is not None]
        return len(words), segments(hits, self.drift)

    def significance(self, n: int, score: float) -> float:
        """-ln of the chance that a clean text of n tokens has a better passage."""
        expected = np.exp(min(50.0, self.log_k + np.log(max(n, 1)) - self.rate * score))
        return float(-np.log(max(-np.expm1(-expected), 1e-300)))

    def score(self, text: str | None) -> float:
        if self.logistic is None:
            return 0.0
        a, b, c = self.logistic
        n, found = self.passages(text)
        x, y = features_of(n, [s for *_, s in found], self)
        score = float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -40, 40))))
        return score if found else min(score, NOTHING)


def segments(hits: list[tuple[int, float]], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments of the walk that moves by weight at each hit (place, weight) and falls by drift elsewhere.

    Each candidate knows the walk's height before and after it, and the last candidate before it that starts lower. A new
    one is joined to that candidate, and all between, if that one ends lower too; the search follows these links only.
    """
    found: list[tuple[int, int, float, float, int]] = []  # start, end, height before, height after, link
    rise, seen = 0.0, 0
    for at, weight in hits:
        left = rise - drift * (at - seen)
        start, rise, seen = at, left + weight, at + 1
        if weight <= 0:
            continue
        link = len(found) - 1
        while True:
            while link >= 0 and found[link][2] >= left:
                link = found[link][4]
            if link < 0 or found[link][3] >= rise:
                found.append((start, at + 1, left, rise, link))
                break
            start, _, left, _, before = found[link]
            del found[link:]
            link = before
    return [(a, b, after - before) for a, b, before, after, _ in found]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> DataFrame:
    """(text, toxic, weight) of at most limit labelled rows outside the held-out fold.

    The chosen ids and the weights, at most limit, are broadcast, so that no text is shuffled.
    """
    wanted = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    wanted = wanted.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(texts.join(F.broadcast(wanted), "doc_id"), "labelled")
    keys = written(rows.select("doc_id", "text").mapInArrow(copy_keys, "doc_id bigint, place int, key bigint"), "copy_keys")
    shared = keys.groupBy("place", "key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    weights = keys.join(F.broadcast(shared), ["place", "key"], "left").groupBy("doc_id").agg(F.floor(ONE / F.coalesce(F.max("c"), F.lit(1))).cast("bigint").alias("weight"))
    return rows.join(F.broadcast(weights), "doc_id").select("text", "toxic", "weight")


def copy_keys(batches):
    """The smallest hashes of each text's pairs of tokens, by COPY_KEYS hash functions."""
    import pyarrow as pa

    times = np.random.default_rng(COPY_KEYS).integers(1, 1 << 62, COPY_KEYS, np.uint64) * np.uint64(2) + np.uint64(1)
    for batch in batches:
        keys = []
        for text in batch.column(1).to_pylist():
            words = [zlib.crc32(w.encode()) for w in tokens(text)] or [0]
            words = hashing.mix(np.array(words, np.uint64))
            pairs = hashing.mix(words[:-1] * np.uint64(3) + words[1:]) if len(words) > 1 else words
            keys += [int(hashing.mix(pairs * t).min()) >> 1 for t in times]
        places = np.tile(np.arange(COPY_KEYS, dtype=np.int32), batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(0)), COPY_KEYS), pa.int64()), pa.array(places), pa.array(keys, pa.int64())], ["doc_id", "place", "key"])


def token_table(rows: DataFrame) -> DataFrame:
    """(token, toxic, other): the weight of the documents of either kind that hold the token. Summed in each task first."""

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        kinds = Counter(), Counter()
        for batch in batches:
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                kind = kinds[toxic > 0]
                for token in set(tokens(text)) - {""}:
                    kind[token] += weight
        names = list(kinds[0].keys() | kinds[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([kinds[1][x] for x in names], pa.int64()), pa.array([kinds[0][x] for x in names], pa.int64())], ["token", "toxic", "other"])

    found = rows.mapInArrow(count, "token string, toxic bigint, other bigint")
    return found.groupBy("token").agg((F.sum("toxic") / ONE).alias("toxic"), (F.sum("other") / ONE).alias("other"))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAIN) -> Model:
    """Only the model's tokens and some figures a training row reach the driver; both are bounded by limit rows."""
    rows = training_rows(docs, labels, limit)
    kinds = {r["toxic"]: r["n"] / ONE for r in rows.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.sum("weight").alias("n")).collect()}
    n1, n0 = kinds.get(True, 0), kinds.get(False, 0)
    if not n1 or not n0:
        return Model()
    prior = (F.col("toxic") + F.col("other")) * PRIOR / (n1 + n0)
    odds = lambda y, n: F.log((y + prior * n / (n1 + n0)) / (n + PRIOR * n / (n1 + n0) - y - prior * n / (n1 + n0)))
    spread = F.sqrt(1 / (F.col("toxic") + prior * n1 / (n1 + n0)) + 1 / (F.col("other") + prior * n0 / (n1 + n0)))
    table = token_table(rows).withColumn("odds", F.round(odds(F.col("toxic"), n1) - odds(F.col("other"), n0), 6)).withColumn("z", F.round(F.col("odds") / spread, 6))
    table = table.filter((F.abs("z") >= MIN_Z) & (F.abs("odds") >= MIN_ODDS)).select("token", "odds").collect()
    model = Model({r["token"]: max(-TOP_WEIGHT, min(float(r["odds"]), TOP_WEIGHT)) for r in table})
    clean = clean_weights(rows, model)
    model.drift = max(DRIFT, 2 * sum(w * share for w, share in clean.items()))
    found = best_segments(rows, model)
    null = found["toxic"] == 0
    model.rate, model.log_k = extreme_value(found["n"][null], found["best"][null], found["weight"][null], clean, model.drift)
    surely = np.array([features_of(n, x, model) for n, x in zip(found["n"], found["scores"], strict=True)])
    model.logistic = logistic(np.column_stack([np.ones(len(surely)), surely]), (~null).astype(float), found["weight"])
    return model


def clean_weights(rows: DataFrame, model: Model) -> dict[float, float]:
    """Each token weight's share of the tokens of the mean clean document."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            total: dict[float, float] = {}
            seen = 0.0
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = [] if toxic else tokens(text)
                seen += 0 if toxic else weight / ONE
                for w in words:
                    if (s := model.weights.get(w)) is not None:
                        total[round(s, 2)] = total.get(round(s, 2), 0.0) + weight / ONE / len(words)
            yield pa.RecordBatch.from_arrays([pa.array([None, *total], pa.float64()), pa.array([seen, *total.values()], pa.float64())], ["weight", "share"])

    found = rows.mapInArrow(scan, "weight double, share double").groupBy("weight").agg(F.round(F.sum("share"), 9).alias("share")).collect()
    seen = sum(r["share"] for r in found if r["weight"] is None)
    return {r["weight"]: r["share"] / seen for r in sorted(found, key=lambda r: r["weight"] or 0) if r["weight"] is not None}


def best_segments(rows: DataFrame, model: Model) -> dict:
    """Per training row its number of tokens, kind, weight, the scores of its segments and the best of them."""

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text, toxic, weight in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, found = model.passages(text)
                out.append({"n": n, "toxic": toxic, "weight": weight / ONE, "scores": [s for *_, s in found]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("n", pa.int64()), ("toxic", pa.int32()), ("weight", pa.float64()), ("scores", pa.list_(pa.float64()))]))

    found = rows.mapInArrow(scan, "n bigint, toxic int, weight double, scores array<double>").toPandas()
    found = found.assign(best=[max(s, default=0.0) for s in found["scores"]]).sort_values(["n", "toxic", "weight", "best"])
    return {c: found[c].to_numpy() for c in found}


def extreme_value(n: np.ndarray, best: np.ndarray, weight: np.ndarray, clean: dict[float, float], drift: float) -> tuple[float, float]:
    """(lambda, ln K): lambda by bisection of E exp(lambda s) = 1; ln K by the mean of a Gumbel law."""
    if not clean:
        return 1.0, 0.0
    weights, share = np.array(list(clean)), np.array(list(clean.values()))
    mean = lambda x: float(np.sum(share * np.exp(np.minimum(x * weights, 60))) + (1 - share.sum()) * np.exp(-x * drift)) - 1
    low, high = 1e-3, 10.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 0 else (low, mid)
    some = best > 0
    if not some.any():
        return low, 0.0
    return low, float(np.average(low * best[some] - np.log(np.maximum(n[some], 1)), weights=weight[some]) - np.euler_gamma)


def features_of(n: int, scores: list[float], model: Model) -> tuple[float, float]:
    """The significance of the best passage, and the logarithm of 1 + the number of significant ones."""
    surely = [model.significance(n, s) for s in scores]
    return (min(max(surely), 60.0), float(np.log1p(sum(x > -np.log(SIGNIFICANT) for x in surely)))) if surely else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> tuple[float, float, float]:
    """Newton's method with a small ridge."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(b) for b in beta)


def scored(docs: DataFrame, model: Model, carry: list[str] | None = None) -> DataFrame:
    """carry's columns (doc_id by default) as _row, and _score, of each row."""
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry or ["doc_id"]]).alias("_row"), F.col("text").cast("string").alias("_text"))

    def apply(batches):
        import pyarrow as pa

        for batch in batches:
            score = pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), score], ["_row", "_score"])

    return base.mapInArrow(apply, StructType([base.schema["_row"], StructField("_score", DoubleType())]))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs.withColumn("doc_id", F.col("doc_id").cast("bigint")), fit(docs, labels))
    return out.select("_row.doc_id", F.col("_score").alias("score")).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that aren't judged toxic, with all columns of docs."""
    return scored(docs, fit(docs, labels), docs.columns).filter(F.col("_score") < 0.5).select("_row.*")


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """A row for each significant passage: doc_id, first and last word (from 0), score and chance."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64()), ("chance", pa.float64())])
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n, found = model.passages(text)
                out += [{"doc_id": doc, "first_word": a, "last_word": b - 1, "score": s, "chance": float(np.exp(-x))} for a, b, s in found if (x := model.significance(n, s)) > -np.log(SIGNIFICANT)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return base.mapInArrow(find, "doc_id bigint, first_word bigint, last_word bigint, score double, chance double")
