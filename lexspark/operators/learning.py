"""Trained models: dating and borrowing classifiers, alignment of embedding spaces, fewer dimensions, rate anomalies.

Classifiers are fitted on at most SAMPLE labelled rows, those with the smallest hashes of their id, and applied to all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, NaiveBayes
from pyspark.ml.feature import IDF, PCA, HashingTF, IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import ascii_words

#: Labelled rows that a classifier is fitted on at most; every row is classified.
SAMPLE = 50_000
FEATURES = 1 << 13
WIDTH = 250


def sampled(labelled: DataFrame, key: str, sample: int = SAMPLE) -> DataFrame:
    """The same rows for every partitioning: those with the smallest hashes of their key."""
    return labelled.orderBy(F.xxhash64(key), key).limit(sample)


def labelled(docs: DataFrame) -> DataFrame:
    """doc_id, words with their three-letter parts, and the first year of the claimed period as label; nulls have no label."""
    label = (F.floor(F.col("year") / WIDTH) * WIDTH).cast("int").cast("string")
    words = ascii_words(F.coalesce("text", F.lit("")))
    parts = F.flatten(F.transform(F.array_distinct(words), lambda w: F.when(F.length(w) > 3, F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.concat(F.lit("#"), F.substr(w, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))))
    return docs.select("doc_id", F.concat(words, parts).alias("words"), label.alias("claimed"))


def fit_dating(docs: DataFrame, sample: int = SAMPLE) -> PipelineModel:
    """Naive Bayes on TF-IDF of words and parts of words."""
    x = sampled(labelled(docs).filter("claimed is not null"), "doc_id", sample)
    index = StringIndexer(inputCol="claimed", outputCol="label", handleInvalid="keep").fit(x)
    names = IndexToString(inputCol="prediction", outputCol="period", labels=index.labels)
    return Pipeline(stages=[index, HashingTF(inputCol="words", outputCol="counts", numFeatures=FEATURES), IDF(inputCol="counts", outputCol="features"), NaiveBayes(), names]).fit(x)


def classify(docs: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(labelled(docs)).select("doc_id", F.col("period").cast("int").alias("period"), F.col("claimed").cast("int").alias("claimed"))


WORD_FEATURES = ("letters", "vowels", "foreign", "senses", "year")


def word_features(words: DataFrame) -> DataFrame:
    """words (id, form, definitions, year, kind) as numbers: length, share of vowels, rare letters, senses and year."""
    n = F.greatest(F.length("form"), F.lit(1))
    share = lambda letters: (n - F.length(F.regexp_replace(F.lower("form"), f"[{letters}]", ""))) / n
    return words.filter("form <> ''").select(
        "id", "kind", F.length("form").cast("double").alias("letters"), share("aeiouyáéíóúäëïöü").alias("vowels"), share("xzqjkw").alias("foreign"),
        F.coalesce(F.size("definitions"), F.lit(0)).cast("double").alias("senses"), F.coalesce(F.col("year") / 1000, F.lit(0.0)).alias("year"),
    )


def fit_borrowing(words: DataFrame, sample: int = SAMPLE) -> PipelineModel:
    """Gradient-boosted trees that tell borrowed words from inherited ones."""
    x = sampled(word_features(words).filter("kind in ('borrowed', 'inherited')"), "id", sample).withColumn("label", (F.col("kind") == "borrowed").cast("double"))
    return Pipeline(stages=[VectorAssembler(inputCols=[*WORD_FEATURES], outputCol="features"), GBTClassifier(maxIter=8, maxDepth=3, seed=7)]).fit(x)


def judge_borrowing(words: DataFrame, model: PipelineModel) -> DataFrame:
    """(id, kind, guess) of every word with a form."""
    return model.transform(word_features(words)).select("id", "kind", F.when(F.col("prediction") == 1, "borrowed").otherwise("inherited").alias("guess"))


def rate_anomalies(series: DataFrame, z: float = 2.0) -> DataFrame:
    """(key, bin, n, z): counts whose second difference is far from the mean of its key's. series (key, bin, n)."""
    w = Window.partitionBy("key").orderBy("bin")
    x = series.withColumn("a", F.col("n") - 2 * F.lag("n", 1).over(w) + F.lag("n", 2).over(w)).filter("a is not null")
    g = x.groupBy("key").agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("sd"))
    y = x.join(g, "key").withColumn("z", F.round((F.col("a") - F.col("m")) / F.nullif(F.col("sd"), F.lit(0.0)), 6))
    return y.filter(F.abs("z") > z).select("key", "bin", "n", "z")


def procrustes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that brings the rows of a closest to those of b."""
    return rotation(a.T @ b)


def rotation(product: np.ndarray) -> np.ndarray:
    """The same from the product of the transposed first with the second."""
    u, _, v = np.linalg.svd(product)
    return u @ v


def fit_alignment(pairs: DataFrame, dims: int) -> np.ndarray:
    """The rotation of pairs (a, b) of vectors. Tasks add up one square matrix each; only their sum, dims * dims numbers,
    reaches the driver."""
    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((dims, dims))
        for x in batches:
            m += np.stack(x["a"].to_numpy()).T @ np.stack(x["b"].to_numpy())
        yield pd.DataFrame({"place": np.arange(dims * dims), "v": m.ravel()})

    rows = pairs.filter(f"size(a) = {dims} and size(b) = {dims}").select("a", "b").mapInPandas(products, "place bigint, v double").groupBy("place").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(dims * dims)
    for r in rows:
        m[r["place"]] = r["v"]
    return rotation(m.reshape(dims, dims))


def aligned(vectors: DataFrame, column: str, turn: np.ndarray) -> DataFrame:
    """vectors with the column turned: each place is the sum of the old ones with the weights of the rotation."""
    weights = F.array(*[F.array(*[F.lit(float(x)) for x in turn[:, j]]) for j in range(turn.shape[1])])
    return vectors.withColumn(column, F.transform(weights, lambda w: F.aggregate(F.zip_with(F.col(column), w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))))


def reduced(vectors: DataFrame, column: str, k: int) -> DataFrame:
    """vectors with the column in k dimensions by principal components."""
    x = vectors.withColumn("_v", array_to_vector(column))
    model = PCA(k=k, inputCol="_v", outputCol="_r").fit(x)
    return model.transform(x).withColumn(column, vector_to_array("_r")).drop("_v", "_r")
