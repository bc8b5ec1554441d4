"""Text classification as Spark jobs: naive Bayes in SQL terms, an MLlib model, and a slot for any vectorised model."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer, StringIndexer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostvigil.functions.text import is_blank, tokens
from hostvigil.operators.ordered import evaluate_once
from hostvigil.session import materialize

LIVE_CHARS = 512
HASH_DIGITS = 4
BLANK_SCORE = 0.9999
ERROR_SCORE = 0.50
BATCH_TEXTS = 128
SHARED_CELLS = 4_000_000  # values of a model, tokens times labels, that is shared with executors


def class_labels(rows: DataFrame) -> list[str]:
    """Sorted class labels of a labelled table. They are the columns of a model, so the driver holds them."""
    found = rows.where(F.col("label").isNotNull()).select("label").distinct()
    return sorted(row.label for row in found.collect())


def features(text: Column, digits: int | None = None) -> Column:
    """Tokens of the whole text; with ``digits``, the first hexadecimal digits of their MD5, 16^digits values at most."""
    found = tokens(text)
    return found if digits is None else F.transform(found, lambda t: F.left(F.md5(t), F.lit(digits)))


def tokenize(rows: DataFrame, key: str = "ord", text: str = "text", limit: int = 256) -> DataFrame:
    """One row per token with its position."""
    return rows.select(key, F.posexplode(tokens(F.col(text), limit)).alias("position", "token"))


def token_counts(rows: DataFrame, labels: list[str], digits: int | None = None) -> DataFrame:
    """Occurrences of each token per label, one row per token with an array in label order.

    Counting is partial before the first shuffle, so frequent tokens do not pile up. An occurrence moves one counter, that
    of its token and label; only these counts are dealt to the labels.
    """
    words = rows.select("label", F.explode(features(F.col("text"), digits)).alias("token"))
    pairs = words.groupBy("token", "label").agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    counted = pairs.groupBy("token").agg(*[F.coalesce(F.sum(F.when(F.col("label") == name, F.col("n")).otherwise(zero)), zero).alias(f"c{i}") for i, name in enumerate(labels)])
    return counted.select("token", F.array(*[f"c{i}" for i in range(len(labels))]).alias("counts"))


def nb_train(rows: DataFrame, labels: list[str], digits: int | None = None) -> DataFrame:
    """Multinomial naive Bayes with add-one smoothing over whole texts, as (token, logp) with one value per label.

    The row with the empty token holds the log priors; no text has that token. With ``digits`` tokens are hashed, and the
    model has at most 16^digits rows however large the vocabulary is.
    """
    counts = materialize(token_counts(rows, labels, digits), "token-counts")
    sizes = rows.agg(*[F.count_if(F.col("label") == name) for name in labels], F.count(F.lit(1))).first()
    return nb_from_counts(counts, list(sizes[:-1]), sizes[-1])


def nb_from_counts(counts: DataFrame, sizes: list[int], rows: int | None = None) -> DataFrame:
    """The model of stored (token, counts) and the number of texts per label; ``rows`` may count texts of other labels too."""
    n, total = range(len(sizes)), sum(sizes) if rows is None else rows
    totals = counts.agg(F.array(*[(F.coalesce(F.sum(F.get("counts", F.lit(i))), F.lit(0)) + F.count(F.lit(1))).cast("double") for i in n]).alias("t")).scalar()
    logp = F.transform("counts", lambda c, i: F.log((c + 1.0) / F.get(F.col("_totals"), i)))
    priors = [math.log(size / total) if size else float("-inf") for size in sizes]
    prior = counts.sparkSession.createDataFrame([("", priors)], "token STRING, logp ARRAY<DOUBLE>")
    return counts.withColumn("_totals", totals).select("token", logp.alias("logp")).unionByName(prior)


def nb_score(rows: DataFrame, model: DataFrame, labels: list[str], key: str = "seq", text: str = "clean_text", digits: int | None = None, chars: int | None = None, shared: int = SHARED_CELLS) -> DataFrame:
    """Add prediction, confidence (4 decimals) and scores, best label first, to rows with a unique key.

    The whole text counts; a live predictor reads the first ``chars`` characters. A model of at most ``shared`` values,
    which is counted, is shared with the executors, and each row is scored where it stands, without a shuffle. Of a larger
    one the likeliest tokens are shared, as many as fit. Only the other tokens of a text, counted in its row, are shuffled
    to meet the rest of the model, and the rows join their scores at the end.
    """
    read = F.col(text) if chars is None else F.left(F.col(text), F.lit(chars))
    most = shared // max(1, len(labels))
    if model.limit(most + 1).count() <= most:
        scored = rows.withColumn("_s", log_sums(model)(features(read, digits))["sums"])
        return with_ranking(scored, labels).select(*rows.columns, "prediction", "confidence", "scores")
    head, tail = parted(model, most)
    near = materialize(rows.select(key, log_sums(head)(features(read, digits)).alias("_h")).select(key, "_h.*"), "shared-scores")
    n = range(len(labels))
    words = near.select(key, F.inline("rest"))
    found = words.join(tail, "token").groupBy(key).agg(F.array(*[F.sum(F.get("logp", F.lit(i)) * F.col("times")) for i in n]).alias("_far"))
    none = F.array(*[F.lit(0.0) for _ in n])
    total = near.join(found, key, "left").select(key, F.zip_with("sums", F.coalesce("_far", none), lambda a, b: a + b).alias("_s"))
    return rows.join(with_ranking(total, labels), key).select(*[rows[c] for c in rows.columns], "prediction", "confidence", "scores")


def parted(model: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """A model in two: the priors with the tokens that are likeliest in any class, about ``most`` at most, and the rest.

    Tokens are ranked by hundredths of their highest log probability, a few thousand values, which the driver counts. Of
    the value on the border a share is taken by the tokens' hashes.
    """
    prior = F.col("token") == ""
    rank = F.floor(F.coalesce(F.array_max("logp"), F.lit(float("-inf"))) * -100)
    sizes = model.where(~prior).groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n")).collect()
    border, share, left = -1, 0, most
    for row in sorted(sizes, key=lambda r: r["rank"]):
        border, share = row["rank"], min(1000, 1000 * left // row.n)
        left -= row.n
        if left <= 0:
            break
    first = prior | (rank < border) | ((rank == border) & (F.pmod(F.xxhash64("token"), F.lit(1000)) < share))
    return model.where(first), model.where(~first)


def log_sums(model: DataFrame) -> Callable[[Column], Column]:
    """A column function from tokens to the log score of each label, by a model whose size is known to be small.

    It gives ``sums``, and in ``rest`` the tokens that the model does not hold, with how often each is there.
    """
    found = model.toArrow()
    names = found.column("token").cast(pa.large_string()).combine_chunks()
    logp = found.column("logp").combine_chunks().flatten().to_numpy().reshape(len(names), -1)
    padded = np.vstack([logp, np.zeros(logp.shape[1])])  # a token that was not met adds nothing
    # Tokens stay an Arrow array: a dict of them takes several times the memory in the driver and in each Python worker.
    shared = model.sparkSession.sparkContext.broadcast((names, padded, logp[names.index("").as_py()]))

    @F.arrow_udf("struct<sums: array<double>, rest: array<struct<token: string, times: bigint>>>")
    def sums(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, values, priors = shared.value
        none = len(known)
        for part in parts:
            codes = part.flatten().dictionary_encode()
            place = pc.index_in(known, value_set=codes.dictionary.cast(pa.large_string()))  # of each token of the model in the part's
            of_code = np.full(len(codes.dictionary), none)
            of_code[place.drop_null().to_numpy()] = np.flatnonzero(place.is_valid().to_numpy(zero_copy_only=False))
            each = codes.indices.to_numpy()
            at = of_code[each]
            owner = np.repeat(np.arange(len(part)), pc.fill_null(pc.list_value_length(part), 0).to_numpy())
            total = np.stack([np.bincount(owner, weights=values[at, j], minlength=len(part)) for j in range(values.shape[1])], axis=1) + priors
            offsets = np.arange(0, total.size + 1, values.shape[1], dtype=np.int32)
            new = at == none
            pairs, times = np.unique(owner[new] * max(1, len(codes.dictionary)) + each[new], return_counts=True)
            of, token = np.divmod(pairs, max(1, len(codes.dictionary)))
            rest = pa.StructArray.from_arrays([codes.dictionary.take(pa.array(token)), pa.array(times, pa.int64())], names=["token", "times"])
            borders = pa.array(np.searchsorted(of, np.arange(len(part) + 1)), pa.int32())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(total.ravel())), pa.ListArray.from_arrays(borders, rest)], names=["sums", "rest"])

    return sums


def with_ranking(total: DataFrame, labels: list[str]) -> DataFrame:
    """Softmax over the log scores in _s; scores is ranked by score (millionths), then label.

    Arrays keep the generated code small however many labels there are; what each element needs is computed before.
    """
    steps = evaluate_once(total.withColumn("_m", F.array_max("_s")), "_s", "_m")
    steps = evaluate_once(steps.withColumn("_e", F.transform("_s", lambda s: F.exp(s - F.col("_m")))), "_e")
    steps = evaluate_once(steps.withColumn("_z", F.aggregate("_e", F.lit(0.0), lambda a, e: a + e)), "_z")
    names = F.lit(labels)

    def entry(s: Column, i: Column) -> Column:
        share = F.get(F.col("_e"), i) / F.col("_z")
        return F.struct((-F.rint(s * 1e6)).alias("rank"), F.get(names, i).alias("label"), share.alias("score"))

    ranked = steps.withColumn("scores", F.sort_array(F.transform("_s", entry))).drop("_s", "_m", "_e", "_z")
    best = F.get("scores", F.lit(0))
    return ranked.withColumns({"prediction": best["label"], "confidence": F.round(best["score"], 4)})


def topk_predictions(scored: DataFrame, key: str = "seq", k: int = 3) -> DataFrame:
    """The k best labels of each text, one row each."""
    best = F.posexplode(F.slice("scores", 1, k)).alias("position", "entry")
    return scored.select(key, best).select(key, (F.col("position") + 1).alias("rank"), F.col("entry.label").alias("label"), F.round("entry.score", 4).alias("score"))


def with_guards(rows: DataFrame, score: Callable[[DataFrame], DataFrame], text: str = "clean_text") -> DataFrame:
    """Score rows that hold text; blank ones are Benign with near certainty."""
    blank = is_blank(F.col(text))
    scored = score(rows.where(~blank))
    fixed = rows.where(blank).withColumns(
        {
            "prediction": F.lit("Benign"),
            "confidence": F.lit(BLANK_SCORE),
            "scores": F.array(F.struct(F.lit(0.0).alias("rank"), F.lit("Benign").alias("label"), F.lit(BLANK_SCORE).alias("score"))),
        }
    )
    return scored.unionByName(fixed.select(*scored.columns))


Model = Callable[[list[str]], list[tuple[str, float]]]


def udf_scorer(load: Callable[[], Model], batch: int = BATCH_TEXTS) -> Callable[[Column], Column]:
    """A column function that scores text with the user's model, loaded once per task and called batch-wise.

    A batch the model fails on is scored text by text, and a text it fails on counts as Benign at 0.50.
    """

    @F.pandas_udf("label string, confidence double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()

        def guarded(texts: list[str]) -> list[tuple[str, float]]:
            try:
                return model(texts)
            except Exception:
                return [("Benign", ERROR_SCORE)] if len(texts) == 1 else [r for t in texts for r in guarded([t])]

        for part in parts:
            texts = part.fillna("").tolist()
            full = [i for i, t in enumerate(texts) if t.strip()]
            out = [("Benign", BLANK_SCORE)] * len(texts)
            for start in range(0, len(full), batch):
                chosen = full[start : start + batch]
                for i, result in zip(chosen, guarded([texts[i] for i in chosen])):
                    out[i] = result
            yield pd.DataFrame(out, columns=["label", "confidence"])

    return score


def score_with_udf(rows: DataFrame, load: Callable[[], Model], text: str = "clean_text", batch: int = BATCH_TEXTS, chars: int = LIVE_CHARS) -> DataFrame:
    """Add prediction and confidence from a vectorised model that reads ``chars`` characters of a line; no shuffle."""
    score = udf_scorer(load, batch)
    scored = rows.withColumn("_p", score(F.left(F.col(text), F.lit(chars))))
    return scored.select(*rows.columns, F.col("_p.label").alias("prediction"), F.col("_p.confidence").alias("confidence"))


def nb_udf_scorer(model: DataFrame, labels: list[str], text: str = "clean_text", digits: int = HASH_DIGITS, chars: int = LIVE_CHARS) -> Callable[[DataFrame], DataFrame]:
    """A hashed naive Bayes model as a row-wise scorer that needs no shuffle and also runs on streams.

    The model was trained with the same ``digits``, so it has at most 16^digits rows whatever it was trained on, and can be
    shared with all executors. Rows without text get NULLs. Texts are tokenised in the JVM, so both scorers see the same
    tokens.
    """
    rows = model.collect()  # at most 16^digits + 1
    index = {row.token: i for i, row in enumerate(rows)}
    shared = model.sparkSession.sparkContext.broadcast((index, np.array([row.logp for row in rows], dtype=float)))
    names = np.array(labels, dtype=object)

    @F.pandas_udf("prediction string, confidence double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known, logp = shared.value
        none = len(logp)
        padded = np.vstack([logp, np.zeros(logp.shape[1])])  # a token that was not met adds nothing
        for part in parts:
            given = part.notna().to_numpy()
            at = [np.fromiter((known.get(w, none) for w in words), dtype=np.int64, count=len(words)) for words in part[given]]
            # A token that adds nothing stands before each text, so that no sum is empty.
            starts = np.cumsum([0, *[len(a) + 1 for a in at]])[:-1]
            flat = np.concatenate([x for a in at for x in ([none], a)]).astype(np.int64) if at else np.empty(0, np.int64)
            total = logp[known[""]] + (np.add.reduceat(padded[flat], starts, axis=0) if at else np.empty((0, logp.shape[1])))
            best = np.round(total, 6).argmax(axis=1) if at else np.empty(0, np.int64)
            share = 1.0 / np.exp(total - total[np.arange(len(best)), best][:, None]).sum(axis=1)
            out = pd.DataFrame({"prediction": pd.Series([None] * len(part), dtype=object), "confidence": np.full(len(part), np.nan)})
            out.loc[given, "prediction"] = names[best]
            out.loc[given, "confidence"] = np.floor(share * 10_000 + 0.5) / 10_000
            yield out

    def add_scores(frame: DataFrame) -> DataFrame:
        scored = frame.withColumn("_p", score(features(F.left(F.col(text), F.lit(chars)), digits)))
        known = F.col("_p.prediction").isNotNull()
        return scored.select(*frame.columns, "_p.prediction", F.when(known, F.col("_p.confidence")).alias("confidence"))

    return add_scores


def lr_train(rows: DataFrame, features: int = 1 << 14, iterations: int = 20) -> PipelineModel:
    """Logistic regression over hashed TF-IDF word features; save and load with the returned model's own methods.

    Texts are cut into words once: their counts are stored, and the weights of words and the regression read those. A
    missing text has no words; a row without a label teaches nothing and is passed over.
    """
    rows = rows.where(F.col("label").isNotNull()).withColumn("text", F.coalesce("text", F.lit("")))
    ids = StringIndexer(inputCol="label", outputCol="label_id", stringOrderType="alphabetAsc").fit(rows)
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern="[^\\p{L}\\p{N}]+")
    hashed = HashingTF(inputCol="words", outputCol="tf", numFeatures=features)
    counted = materialize(PipelineModel([ids, words, hashed]).transform(rows).select("label_id", "tf"), "word-counts")
    weights = IDF(inputCol="tf", outputCol="features").fit(counted)
    fitted = LogisticRegression(labelCol="label_id", maxIter=iterations, regParam=0.01).fit(weights.transform(counted).select("label_id", "features"))
    return PipelineModel([ids, words, hashed, weights, fitted])


def lr_score(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add predicted_label and confidence to every row; a missing text has no words."""
    from pyspark.ml.functions import vector_to_array

    scored = PipelineModel(model.stages[1:]).transform(rows.withColumns({"_given": F.col("text"), "text": F.coalesce("text", F.lit(""))}))
    names = F.lit(list(model.stages[0].labels))
    return scored.select(
        *[F.col("_given").alias(c) if c == "text" else F.col(c) for c in rows.columns],
        F.get(names, F.col("prediction").cast("int")).alias("predicted_label"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
