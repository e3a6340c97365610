"""The sample against counting word by word, for one and for two words a feature, and odd rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from newsloom.llm.resampling import resample

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least, longest, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in features(text, longest)[1])
    t = Counter(bucket(f) for text in target for f in features(text, longest)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    out, able = [], []
    for doc_id, text in rows:
        words, found = features(text, longest)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        row = [doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if words >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, row in enumerate(able[: percent * len(able) // 100]):
        row[4] = i + 1
    return sorted(map(str, out))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_odd_rows(spark, frame, odd_texts, longest):
    rows = [*odd_texts, *[(100 + i, f"Alpha beta{i % 5} gamma-delta é{i} " * (i % 7), "x") for i in range(60)]]
    target = [(1, "alpha beta1 GAMMA"), (2, None), (3, ""), (4, "word3 word7919 alpha beta1")]
    got = resample(frame(rows), spark.createDataFrame(target, "item_id long, text string"), 30, 4, longest, 50)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(str(list(r)) for r in got.collect()) == brute([r[:2] for r in rows], [t for _, t in target], 30, 4, longest, 50)


def test_empty_tables(spark, frame):
    nothing = spark.createDataFrame([], "text string")
    assert resample(frame([]), nothing).collect() == []
    assert [r.rank for r in resample(frame([(1, "a b", "x")]), nothing, 100, 1).collect()] == [1]


def test_a_hot_id(spark, frame):
    """Rows that repeat a third of the table keep ranks of their own."""
    rows = [(7, "same words here again", "a")] * 200 + [(i, f"other words {i}", "a") for i in range(1000, 1400)]
    got = resample(frame(rows), spark.createDataFrame([("same words",)], "text string"), 50, 1).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 301))
