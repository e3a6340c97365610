"""Toxicity of texts by non-negative positive-unlabelled learning.

Only confirmed toxic documents are taken as labels; all others are unlabelled, some of them toxic.
Kiryo et al., "Positive-Unlabeled Learning with Non-Negative Risk Estimator" (2017): with the share
``prior`` of toxic documents among the unlabelled, the risk is
``prior * R(positive as 1) + max(0, R(unlabelled as 0) - prior * R(positive as 0))``, and while the
second part is negative the step goes the other way.

Features are the different byte n-grams of the lower-cased text that lie inside a word or at its
edge, hashed. A bounded sample (``MOST_POSITIVE``, ``MOST_UNLABELLED`` documents, chosen by a hash of
the id) is dealt to MEMBERS tasks. Each keeps the n-grams that are much more frequent in positive
documents and fits a logistic model in numpy; the mean of the members' models scores every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.common import RollingHash, in_pieces, text_bytes

GRAMS, BITS = (5, 6, 8, 10), 20
#: Bounds of the training sample over all members, in expectation.
MOST_POSITIVE, MOST_UNLABELLED, MEMBERS = 6_000, 12_000, 4
MOST_FEATURES, STEPS, RATE, RIDGE = 3_000, 300, 0.05, 2e-3
LEAST_EVIDENCE, LEAST_RATIO = 25.0, 4.0


def _letters() -> np.ndarray:
    """Bytes lower-cased; white space, digits and punctuation become blanks."""
    out = np.full(256, 32, np.uint8)
    out[128:] = np.arange(128, 256)
    out[97:123] = np.arange(97, 123)
    out[65:91] = np.arange(97, 123)
    return out


def grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and feature number of every n-gram, repeated ones included."""
    text = _letters()[raw]
    hashes, blank = RollingHash(text), np.concatenate([[0], np.cumsum(text == 32)])
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.int32)
    rows, features = [], []
    for k, n in enumerate(GRAMS):
        start = np.arange(max(0, len(text) - n + 1))
        # Blanks only at the edges, the whole n-gram in one text.
        start = start[(blank[start + n - 1] == blank[start + 1]) & (owner[start] == owner[start + n - 1])]
        start = start[blank[start + n] - blank[start] < 2]
        rows.append(owner[start])
        features.append((hashes.ranges(start, start + n) >> np.uint64(64 - BITS)).astype(np.int32) + (k << BITS))
    return np.concatenate(rows), np.concatenate(features)


def _distinct(owner: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(owner.astype(np.int64) << 32 | feature)
    return both >> 32, both & 0xFFFFFFFF


def select(own: np.ndarray, other: np.ndarray, n: int, m: int) -> np.ndarray:
    """Features that tell positive documents, the most telling first.

    ``own`` counts by feature the documents that have it among the n positive ones, ``other``
    those among the m unlabelled.

    They are LEAST_RATIO times as frequent there and the difference is beyond chance: the
    likelihood ratio statistic of the two frequencies is over LEAST_EVIDENCE.
    """
    some = np.flatnonzero(own >= 3)
    a, b = own[some], other[some]
    pooled = (a + b) / (n + m)

    def likelihood(hits: np.ndarray, total: int, rate: np.ndarray) -> np.ndarray:
        rate = np.clip(rate, 1e-12, 1 - 1e-12)
        return hits * np.log(rate) + (total - hits) * np.log(1 - rate)

    evidence = 2 * (likelihood(a, n, a / n) + likelihood(b, m, b / m) - likelihood(a, n, pooled) - likelihood(b, m, pooled))
    telling = (evidence >= LEAST_EVIDENCE) & (a / n >= LEAST_RATIO * b / m)
    order = np.argsort(-evidence[telling], kind="stable")[:MOST_FEATURES]
    return some[telling][order]


def fit(rows: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model under the non-negative risk, by Adam on the whole sample."""
    up, un = rows[positive], rows[~positive]
    weights, bias = np.zeros(rows.shape[1]), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(len(weights) + 1), np.zeros(len(weights) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    back = lambda matrix, d: (d.astype(np.float32) @ matrix).astype(float)
    for step in range(1, steps + 1):
        single = weights.astype(np.float32)  # else every product would copy the matrix as doubles
        zp, zu = (up @ single).astype(float) + bias, (un @ single).astype(float) + bias
        unlabelled = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        # Derivatives by the scores: of the negative part, and of the positive one.
        du, dp = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
        gradient = np.append(back(un, du) + back(up, dp), du.sum() + dp.sum())
        if unlabelled < 0:
            gradient = -gradient
        else:
            dq = -prior * sigmoid(-zp) / len(zp)
            gradient += np.append(back(up, dq), dq.sum())
        gradient[:-1] += RIDGE * prior * weights
        first, second = 0.9 * first + 0.1 * gradient, 0.999 * second + 0.001 * gradient**2
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        weights, bias = weights - move[:-1], bias - move[-1]
    return weights, float(bias)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[dict[int, float], float]:
    """Weights by feature and the bias, learned from the rows that are not held out.

    ``labels`` has ``doc_id, toxic``; a document is confirmed toxic if any of its rows says 1. Labels
    of held-out ids (crc32 of the id's decimal text divisible by 5) are not read, and held-out
    documents are not in the sample. Without confirmed or without unlabelled documents there is
    nothing to learn: no weights, and a bias far below zero.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).where(~held_out("id") & F.col("id").isNotNull())
    known = known.groupBy("id").agg(F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic"))
    ids = docs.select(F.col(f"`{id_col}`").cast("long").alias("id")).where(~held_out("id") & F.col("id").isNotNull()).distinct()
    marked = ids.join(known, "id", "left")
    confirmed = F.coalesce(F.col("toxic") == 1, F.lit(False))
    n, labelled, positive = marked.agg(F.count("*"), F.count("toxic"), F.sum(confirmed.cast("long"))).first()
    positive = positive or 0
    if not positive or n == positive:
        return {}, -20.0
    # The unlabelled documents are all but the confirmed; those without any label hold the unknown toxic ones.
    prior = min(0.5, max(1e-3, positive / labelled * (n - labelled) / (n - positive)))
    code = F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(confirmed, F.lit(MOST_POSITIVE / positive)).otherwise(F.lit(MOST_UNLABELLED / (n - positive)))
    # Few confirmed documents make one good model rather than several poor ones.
    members = max(1, min(MEMBERS, positive // 300))
    sample = marked.where(code < rate).select("id", confirmed.alias("positive"), F.pmod(F.xxhash64(F.col("id"), F.lit("member")), F.lit(members)).alias("member"))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").select("member", "id", "positive", "text")

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        mark = table.column("positive").to_numpy(zero_copy_only=False)
        if mark.all() or not mark.any():
            return pa.table({"feature": pa.array([], pa.int32()), "weight": pa.array([], pa.float64())})
        batches = table.combine_chunks().to_batches()

        def found() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            done = 0
            for piece in in_pieces(batches, "text"):
                owner, feature = _distinct(*grams(*text_bytes(piece.column("text"))))
                yield owner + done, feature
                done += piece.num_rows

        size = len(GRAMS) << BITS
        counts = np.zeros((2, size), np.int64)
        for owner, feature in found():
            for k, kind in enumerate((mark, ~mark)):
                counts[k] += np.bincount(feature[kind[owner]], minlength=size)
        chosen = select(*counts, int(mark.sum()), int((~mark).sum()))
        place = np.full(size, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        matrix = np.zeros((len(mark), len(chosen)), np.float32)
        for owner, feature in found():
            at = place[feature]
            matrix[owner[at >= 0], at[at >= 0]] = 1
        weights, bias = fit(matrix, mark, prior)
        return pa.table({"feature": pa.array(np.append(chosen, -1), pa.int32()), "weight": pa.array(np.append(weights, bias), pa.float64())})

    learned = rows.groupBy("member").applyInArrow(learn, "feature int, weight double").groupBy("feature").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    found = learned.orderBy("feature").collect()  # at most MEMBERS * MOST_FEATURES rows
    fitted = next((r["n"] for r in found if r["feature"] == -1), 0)
    if not fitted:
        return {}, -20.0
    return {r["feature"]: r["weight"] / fitted for r in found if r["feature"] >= 0}, next(r["weight"] for r in found if r["feature"] == -1) / fitted


def held_out(id_col: str):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(5)) == 0


def score(docs: DataFrame, model: tuple[dict[int, float], float], carry: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``carry`` of every row, and as ``name`` the score in 0..1 of its whole text; a NULL text is empty and gets the bias alone."""
    weights, bias = model
    names = [f"c{i}" for i in range(len(carry))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)], *([] if text_col in carry else [F.col(f"`{text_col}`").alias("text")]))
    text = names[carry.index(text_col)] if text_col in carry else "text"
    schema = rows.select(*names).schema.add("score", "double")
    keys, values = np.array(list(weights), np.int64), np.array(list(weights.values()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(GRAMS) << BITS, np.float32)
        table[keys] = values
        for piece in in_pieces(batches, text):
            owner, feature = grams(*text_bytes(piece.column(text)))
            hit = table[feature] != 0
            owner, feature = _distinct(owner[hit], feature[hit])
            z = bias + np.bincount(owner, table[feature], minlength=piece.num_rows)[: piece.num_rows]
            made = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
            yield pa.RecordBatch.from_arrays([*[piece.column(n) for n in names], made], [*names, "score"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for c, n in zip(carry, names, strict=True)], F.col("score").alias(name))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    scored = score(docs.withColumn("_id", F.col(f"`{id_col}`").cast("long")), train(docs, labels, id_col, text_col), ["_id"], text_col)
    return scored.select(F.col("_id").alias("doc_id"), held_out("_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
