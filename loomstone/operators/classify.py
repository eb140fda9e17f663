"""Quality and toxicity classifiers: hashed one- and two-word counts under logistic regression."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstone.functions.text import classifier_text
from loomstone.operators.mixing import cap_per_group, fraction, order_key

QUALITY_BITS, TOXIC_BITS = 18, 17
SAMPLE_ROWS = 200_000
"""Labelled rows a model is fitted on at most; a random sample of more."""


def quality_examples(documents: DataFrame, key: str, text: str, share: float, seed: int = 42) -> DataFrame:
    """Positives sampled from curated texts, and as negatives a sound text's beginning cut short, its first ten words five times over, and texts that are short."""
    chosen = documents.where((F.length(text) > 200) & (fraction(seed, F.col(key)) < share))
    body = classifier_text(F.col(text), 2000)
    ten = F.array_join(F.slice(F.split(body, r"\s+"), 1, 10), " ")
    good = chosen.select(key, body.alias("text"), F.lit(1.0).alias("label"))
    cut_short = chosen.select(key, F.substring(body, 1, 50).alias("text"), F.lit(0.0).alias("label"))
    looped = chosen.select(key, F.concat_ws(" ", *[ten] * 5).alias("text"), F.lit(0.0).alias("label"))
    short = documents.where((F.length(text) < 50) & (F.length(text) > 0)).select(key, body.alias("text"), F.lit(0.0).alias("label"))
    return good.unionByName(cut_short).unionByName(looped).unionByName(short)


def toxicity_examples(scored: DataFrame, key: str, text: str, score: str, per_class: int, seed: int = 42) -> DataFrame:
    """Texts of at least 20 characters with a score of 0.5 or more as 1, below 0.1 as 0; between them none; as many of each at most."""
    label = F.when(F.col(score) >= 0.5, 1.0).when(F.col(score) < 0.1, 0.0)
    rows = scored.where(F.length(text) >= 20).select(key, classifier_text(F.col(text), 1000).alias("text"), label.alias("label")).where("label is not null")
    return cap_per_group(rows, "label", per_class, [order_key(seed, F.col(key)), F.col(key)])


def fit(examples: DataFrame, key: str, bits: int = QUALITY_BITS, seed: int = 42) -> PipelineModel:
    """A model of the sampled examples."""
    total = examples.count()
    sample = examples if total <= SAMPLE_ROWS else examples.where(fraction(seed, F.col(key), F.col("text")) < SAMPLE_ROWS / total)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="w1", pattern=r"\W+", toLowercase=True),
        NGram(n=2, inputCol="w1", outputCol="w2"),
        SQLTransformer(statement="SELECT *, concat(w1, w2) AS grams FROM __THIS__"),
        HashingTF(numFeatures=1 << bits, inputCol="grams", outputCol="counts"),
        Normalizer(inputCol="counts", outputCol="features"),
        LogisticRegression(maxIter=20, regParam=1e-5, featuresCol="features", labelCol="label"),
    ]
    return Pipeline(stages=stages).fit(sample)


def score(model: PipelineModel, documents: DataFrame, key: str, text: str, chars: int) -> DataFrame:
    """``key`` and ``probability`` of class 1; null and blank texts have 0."""
    prepared = documents.select(F.col(key), classifier_text(F.coalesce(F.col(text), F.lit("")), chars).alias("text"))
    found = model.transform(prepared)
    return found.select(key, F.when(F.col("text") == "", 0.0).otherwise(vector_to_array("probability")[1]).alias("probability"))


def blended(quality: DataFrame, toxicity: DataFrame, heuristic: DataFrame, key: str, threshold: float = 0.6, toxic: float = 0.5) -> DataFrame:
    """0.6 of the classifier and 0.4 of the heuristic score; toxic texts are rejected first."""
    joined = heuristic.select(key, "quality_score").join(quality.withColumnRenamed("probability", "p_quality"), key).join(toxicity.withColumnRenamed("probability", "p_toxic"), key)
    total = F.round(0.6 * F.col("p_quality") + 0.4 * F.col("quality_score"), 4)
    return joined.withColumn("blended", total).withColumn("verdict", F.when(F.col("p_toxic") >= toxic, "toxic").when(total >= threshold, "kept").otherwise("low"))
