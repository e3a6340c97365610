"""Pages by rank: every page, borders of parts, ties, and the files a page reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from newsloom.operators.ranked import ranked_page, write_ranked
from newsloom.session import new_path


def test_pages_by_rank(spark):
    rows = [(i, i % 7 if i % 5 else None) for i in range(1000)]
    path = new_path(spark, "test-ranked")
    df = spark.createDataFrame(rows, "id long, d int").repartition(5)
    write_ranked(df, path, [F.desc_nulls_last("d"), F.asc("id")], part_rows=90)
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))]
    for page, size in ((1, 10), (9, 10), (10, 9), (3, 300), (100, 10), (20, 50), (21, 50)):
        got = ranked_page(spark, path, page, size, None).collect()
        assert [r.id for r in got] == want[(page - 1) * size : page * size] and {r.total for r in got} <= {1000}
    page = ranked_page(spark, path, 50, 10)
    assert page.select(F.input_file_name()).distinct().count() <= 2 and page.columns == ["id", "d", "total"]
    with pytest.raises(ValueError):
        ranked_page(spark, path, 0)


def test_pages_of_an_empty_table(spark):
    path = new_path(spark, "test-ranked")
    write_ranked(spark.createDataFrame([(1,)], "id long"), path, [F.asc("id")])
    assert ranked_page(spark, path, 2, 10).collect() == []
