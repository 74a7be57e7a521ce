"""User-supplied scorers: arrays or image bytes to vectors, in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from tagloom.functions.vectors import l2_normalize


def vector_scorer(make_predict: Callable, dimension: int, batch_size: int = 1024) -> Callable[[Column], Column]:
    """Batch scorer over fixed-size arrays; the model loads once per worker."""
    return predict_batch_udf(
        make_predict, return_type=t.ArrayType(t.DoubleType()), batch_size=batch_size, input_tensor_shapes=[[dimension]]
    )


def content_scorer(make_scorer: Callable[[], Callable[[list], list]]) -> Callable[[Column], Column]:
    """Scorer over bytes or arrays that may fail per item: a None result is NULL."""

    @F.pandas_udf("array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = make_scorer()
        for batch in batches:
            yield pd.Series(scorer(batch.tolist()), index=batch.index, dtype=object)

    return score


def model_score(rows: DataFrame, score: Column, name: str = "scores") -> DataFrame:
    """Add score vectors; rows the scorer failed on drop."""
    return rows.withColumn(name, score).filter(F.col(name).isNotNull())


def image_embed(rows: DataFrame, score: Column, name: str = "vector") -> DataFrame:
    """Add unit vectors, NULL where the scorer failed or gave a zero vector."""
    return rows.withColumn("_raw", score).withColumn(name, l2_normalize(F.col("_raw"), zero_to_null=True)).drop("_raw")


def explode_predictions(vectors: DataFrame, vocab: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, tag, category, score) for positions that the vocabulary names."""
    rows = vectors.select(key, F.posexplode(vector).alias("pos", "score"))
    names = vocab.select("pos", F.col("name").alias("tag"), "category")
    return rows.join(names, "pos").select(key, "pos", "tag", "category", F.col("score").cast("double").alias("score"))


def build_reference_vectors(
    references: DataFrame, files: DataFrame, scorer: Callable[[Column], Column], names: DataFrame
) -> DataFrame:
    """Score the reference files of enabled entities.

    ``references(character_id, pos, path)``, ``files(path, content)``,
    ``names(character_id, character_name, enabled)``; unreadable files drop.
    """
    enabled = names.filter(F.coalesce("enabled", F.lit(True))).select("character_id", "character_name")
    rows = references.join(enabled, "character_id").join(files, "path")
    scored = model_score(rows, scorer(F.col("content")), "embedding")
    return scored.select("character_id", "character_name", "pos", F.col("path").alias("image_path"), "embedding")
