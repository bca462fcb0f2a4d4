"""Credibility features of a table of documents, and the same as an ML stage."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from truthmill.functions.credibility import extra_ratios, feature_array, ratios, token_counts
from truthmill.functions.tokens import drop_stop_words, ngrams, split_tokens
from truthmill.lexicon import MULTILINGUAL, Lexicon


def with_counts(df: DataFrame, body: str = "content", lexicon: Lexicon = MULTILINGUAL) -> DataFrame:
    return df.withColumn("_counts", token_counts(F.col(body), lexicon))


def credibility_features(
    df: DataFrame, body: str = "content", lexicon: Lexicon = MULTILINGUAL, extras: bool = False
) -> DataFrame:
    """The table without its body, plus the ten ratios (and the extra counters)."""
    counted = with_counts(df, body, lexicon)
    columns = ratios(F.col("_counts"), F.col(body))
    if extras:
        columns = extra_ratios(F.col("_counts"))
    return counted.select(*[c for c in df.columns if c != body], *columns)


def text_columns(df: DataFrame, body: str = "content", lexicon: Lexicon = MULTILINGUAL) -> DataFrame:
    """Adds ``tokens``, ``commonfeatures``, ``filtered`` and ``ngrams``."""
    return (
        df.withColumn("tokens", split_tokens(F.col(body)))
        .withColumn("commonfeatures", array_to_vector(feature_array(F.col(body), lexicon)))
        .withColumn("filtered", drop_stop_words(F.col("tokens"), lexicon.stop))
        .withColumn("ngrams", ngrams(F.col("filtered"), 2))
    )


class CredibilityFeatures(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """ML stage: text column in, vector of the ten ratios out.

    The lexicon is a parameter, as JSON, so a saved stage keeps it.
    """

    lexiconJson = Param(Params._dummy(), "lexiconJson", "word lists of the ratios, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, inputCol: str = "content", outputCol: str = "commonfeatures"):
        super().__init__()
        self._setDefault(inputCol="content", outputCol="commonfeatures", lexiconJson=json.dumps(asdict(MULTILINGUAL)))
        self._set(**self._input_kwargs)

    @property
    def lexicon(self) -> Lexicon:
        lists = json.loads(self.getOrDefault(self.lexiconJson))
        return Lexicon(**{k: v if isinstance(v, dict) else tuple(v) for k, v in lists.items()})

    def setLexicon(self, lexicon: Lexicon) -> "CredibilityFeatures":
        return self._set(lexiconJson=json.dumps(asdict(lexicon)))

    def setInputCol(self, value: str) -> "CredibilityFeatures":
        return self._set(inputCol=value)

    def setOutputCol(self, value: str) -> "CredibilityFeatures":
        return self._set(outputCol=value)

    def transformSchema(self, schema: StructType) -> StructType:
        return StructType(list(schema.fields)).add(self.getOutputCol(), VectorUDT(), True)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        array = feature_array(F.col(self.getInputCol()), self.lexicon)
        return dataset.withColumn(self.getOutputCol(), array_to_vector(array))
