"""Near duplicates against an exact join over all pairs."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np

from newsloom.llm.graph import components
from newsloom.llm.minhash import near_duplicates, signatures


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def exact(rows, up, down):
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and down * len(a & b) >= up * len(a | b):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}


def check(df, rows, up=85, down=100):
    got = near_duplicates(df, threshold=(up, down)).collect()
    want = exact(rows, up, down)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == (want[r.doc_id] if r.doc_id is not None else None)
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    sizes = sorted((str(i), len(shingle_set(t))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sizes


def variants(rng, base, n, most):
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(most)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        yield " ".join(words)


def test_edge_cases(frame, odd_texts):
    check(frame(odd_texts), [r[:2] for r in odd_texts])


def test_crowded_group(frame):
    rng = random.Random(5)
    base = " ".join(f"b{rng.randrange(400)}" for _ in range(150))
    texts = list(variants(rng, base, 300, 5)) + [base.upper()] * 3 + [" ".join(f"u{rng.randrange(500)}" for _ in range(80)) for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    check(frame(rows), [r[:2] for r in rows])
    check(frame(rows), [r[:2] for r in rows], 4, 5)


def template_pages(n, own, links, change, words=400):
    """Pages of one template with words of their own, and copies of some with other words of their own."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(words)]
    pages = []
    for p in range(n):
        page = list(base)
        page[:own] = [f"p{p}x{i}" for i in range(own)]
        pages.append(page)
    for k, p in enumerate(rng.sample(range(n), links)):
        copy = list(pages[p])
        at = rng.randrange(own + 4, words - change)
        copy[at : at + change] = [f"c{k}x{i}" for i in range(change)]
        pages.append(copy)
    rng.shuffle(pages)
    return [(i, " ".join(p), "s") for i, p in enumerate(pages)]


def test_links_inside_a_large_template(frame):
    rows = template_pages(2000, 44, 1500, 26)  # two pages of the template have 0.80 in common, a copy and its page 0.86
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(rows)).collect()}
    sets = [shingle_set(t) for _, t, _ in rows]
    size = [len(s) for s in sets]
    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    place = {g: k for k, g in enumerate(index)}
    has = np.zeros((len(sets), len(place)), np.float32)
    for i, s in enumerate(sets):
        has[i, [place[g] for g in s if len(index[g]) > 1]] = 1
    both = has[:, (has.sum(axis=0) > 0)] @ has[:, (has.sum(axis=0) > 0)].T
    n = np.array(size)
    linked = 100 * both >= 85 * (n[:, None] + n[None, :] - both)
    want = {i: int(linked[i].argmax()) if linked[i].any() else i for i in range(len(sets))}
    assert sum(i != c for i, c in want.items()) == 1500
    assert got == want


def test_tiles_and_short_lists(frame, monkeypatch):
    from newsloom.llm import minhash

    monkeypatch.setattr(minhash, "CROWD", 8)
    monkeypatch.setattr(minhash, "TILE", 16)
    monkeypatch.setattr(minhash, "ROUNDS", (False,))
    rows = template_pages(120, 40, 12, 8, 160)  # less in common than a prefix leaves out: short lists only
    check(frame(rows), [r[:2] for r in rows])
    rows = template_pages(120, 18, 12, 8, 160) + [(500 + i, f"only here {i}", "s") for i in range(5)]
    check(frame(rows), [r[:2] for r in rows])
    check(frame(rows), [r[:2] for r in rows], 4, 5)


def test_sketches_drop_few_links():
    from math import comb

    from newsloom.llm import minhash

    for t in (0.8, 0.85, 0.86, 1.0):
        agree = t + (1 - t) / 16
        floor = minhash._floor(t, 80)
        low = [k for k in range(81) if (k / 80 - 1 / 16) / (15 / 16) < floor]
        assert sum(comb(80, k) * agree**k * (1 - agree) ** (80 - k) for k in low) <= 1e-6
        assert len(low) > 40


def test_empty_table(frame):
    assert near_duplicates(frame([])).collect() == []


def test_signatures_of_copies(frame):
    rows = signatures(frame([(1, "A b c d e f", "s"), (2, "a  B c\td e f", "s"), (3, "a b c d e g", "s")])).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1]["class"] == by[2]["class"] != by[3]["class"] and by[1].signature == by[2].signature


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 400)] + [(1000, i) for i in range(1001, 1300)] + [(7, 7), (None, 3), (101, 100), (101, 100)]
    got = {r.id: r.component_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 401)} | {i: 1000 for i in range(1000, 1300)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_that_polynomial_hashes_confuse(frame):
    """Thue-Morse words and their complements share no shingle."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    rows = [(2 * k + side, word[: 1 << k].translate(str.maketrans("ab", "ba" if side else "ab")), "s") for k in range(5, 13) for side in (0, 1)]
    got = near_duplicates(frame(rows)).collect()
    assert len(got) == len(rows) and all(r.component_id == r.doc_id and r.kept for r in got)


def test_op2_on_the_given_documents(spark, sf_dir):
    """The registered query at 0.85 against all pairs of shingle sets that share a shingle."""
    from newsloom.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    sets, holders, parent = {i: shingle_set(t) for i, t in rows}, {}, {i: i for i, _ in rows}
    for i, own in sets.items():
        for s in own:
            holders.setdefault(s, []).append(i)

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    shared = {}
    for own in holders.values():
        for pair in itertools.combinations(own, 2):
            shared[pair] = shared.get(pair, 0) + 1
    for (i, j), both in shared.items():
        if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
            x, y = root(i), root(j)
            parent[max(x, y)] = min(x, y)
    got = QUERIES["op2_minhash"](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def _left_rows(monkeypatch, frame, wanted):
    """The sizes of the tables with the wanted columns that are joined with others than a filter of keys."""
    sizes, join = [], type(frame).join

    def seen(self, other, *args, **named):
        if set(wanted) <= set(self.columns) and "_bits" not in other.columns:
            sizes.append(self.count())
        return join(self, other, *args, **named)

    monkeypatch.setattr(type(frame), "join", seen)
    return sizes


def test_marked_keeps_every_key(spark):
    from newsloom.llm.common import marked

    rows = spark.range(-50_000, 150_000).selectExpr("CASE WHEN id % 1000 = 7 THEN NULL ELSE id END AS id", "id AS `a b`")
    keys = spark.range(-40_000, 150_000, 70).toDF("k").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k"))
    got = marked(rows, rows["id"], keys, "may")
    assert got.columns == ["id", "a b", "may"] and got.count() == 200_000 and got.where("may IS NULL").count() == 0
    real = rows.join(keys, rows["id"] == keys["k"], "left_semi").count()
    may = got.where("may")
    assert may.join(keys, may["id"] == keys["k"], "left_semi").count() == real and may.count() < 200_000 / 10
    assert marked(rows, rows["id"], keys.limit(0), "may").where("may").count() == 0


def test_texts_without_candidates_are_not_joined(frame, monkeypatch):
    """Few of many texts have candidates or stand in a crowded region: the others stay out of the joins that shuffle texts."""
    rng = random.Random(8)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)), "s") for i in range(1500)]
    rows += [(2000 + i, t, "s") for i, t in enumerate(variants(rng, " ".join(f"v{i}" for i in range(80)), 140, 3))]
    df = frame(rows)
    sizes = _left_rows(monkeypatch, df, ["id", "text"])
    check(df, [r[:2] for r in rows])
    assert sizes and max(sizes) < 300
