"""Unified categories by fuzzy matching against a fixed keyword list."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.fuzzy import token_set_ratio
from newsloom.functions.text import clean_category
from newsloom.schema import CATEGORY_KEYWORDS

#: Names a task remembers at a time.
MEMO_NAMES = 100_000


def fuzzy_category(
    df: DataFrame,
    categories: str = "categories",
    out: str = "main_category",
    keywords: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS,
    threshold: float = 60,
) -> DataFrame:
    """Add the unified category of an array of raw category names.

    The best keyword wins, earlier names and keywords first on ties; below the threshold
    it is "Other". Each task scores a name once and keeps the result in a bounded memo, so
    rows stay where they are: nothing is shuffled, whatever the most frequent category.
    """
    table = [(name, word.lower()) for name, words in keywords.items() for word in words]

    @F.pandas_udf("string")
    def choose(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[float, str | None]] = {}

        def scored(raw):
            if raw not in memo:
                if len(memo) >= MEMO_NAMES:
                    memo.clear()
                top, label = 0.0, None
                for unified, word in table:
                    score = token_set_ratio(raw, word)
                    if score > top:
                        top, label = score, unified
                memo[raw] = top, label
            return memo[raw]

        def best(names):
            top, label = 0.0, None
            for raw in names if names is not None else ():
                if raw and scored(raw)[0] > top:
                    top, label = scored(raw)
            return label if top >= threshold else "Other"

        for batch in batches:
            yield batch.map(best, na_action=None)

    return df.withColumn(out, choose(F.transform(F.col(categories), lambda c: clean_category(c))))
