"""Text embeddings: a hashed TF-IDF default and a hook for any model."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.search import tokens


def text_embed_hash(df: DataFrame, columns: Sequence[str] = ("title", "content"), dim: int = 384, out: str = "embedding") -> DataFrame:
    """Unit-length hashed TF-IDF vectors of the joined text columns.

    Hashing and scaling are row-local; the inverse document frequencies are one pass
    that aggregates a vector of ``dim`` counts.
    """
    words = df.withColumn("_tokens", tokens(F.concat_ws(" ", *columns)))
    counted = HashingTF(numFeatures=dim, inputCol="_tokens", outputCol="_tf").transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
    return unit.withColumn(out, vector_to_array("_unit", "float32")).drop("_tokens", "_tf", "_tfidf", "_unit")


def embed(
    df: DataFrame, columns: Sequence[str], load: Callable[[], Callable[[list[str]], list]], out: str = "embedding"
) -> DataFrame:
    """Embed the joined text columns with a model; ``load`` runs once per Python worker and batch stream."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for texts in batches:
            yield pd.Series(list(encode(texts.tolist())), index=texts.index)

    return df.withColumn(out, run(F.concat_ws(" ", *columns)))
