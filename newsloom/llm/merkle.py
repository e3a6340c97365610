"""Merkle trees over the sections and paragraphs of a document, in DataFrame operations only.

A section ends at an empty line, a paragraph at a line break. The leaves are one to four words (long ones
in pieces) with the white space behind them, so nothing of the text is outside the leaves. A leaf ends early
behind a word with a certain last letter, so leaves fall into step again behind an edit; one rule
holds for texts of every length. A node is the hash of its children's hashes, the root that of the
sections: two roots are equal exactly if the texts are, and where they differ, only the branches
that differ need be looked at.

The fingerprint carries the root, eight digits of each paragraph's hash, and a sketch of the leaves:
the SKETCH smallest hashes of leaves, the second occurrence of a leaf being another element than the
first. So two fingerprints tell how alike two texts are, without the texts.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A word, and the white space inside a line.
WORD, BLANK = r"[^\x20\x09-\x0D]", r"[\x20\x09\x0B-\x0D]"
#: Characters of a word's piece that is a leaf of its own, at most.
PIECE = 8
#: Elements of a fingerprint's sketch, each eight digits.
SKETCH = 128
#: A word with any other last letter lets the leaf go on, up to LEAF_WORDS words.
LAST, LEAF_WORDS = "nsy.,0369", 4
LEAF = f"(?:{WORD}{{0,{PIECE - 1}}}[^\\x20\\x09-\\x0D{LAST}]{BLANK}+){{0,{LEAF_WORDS - 1}}}{WORD}{{1,{PIECE}}}{BLANK}*|{BLANK}+"


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def tree(text: Column) -> Column:
    """``struct<root, sections, paragraphs, leaves>``: hashes by level, ``paragraphs`` and ``leaves`` nested in their parents."""
    leaves = F.transform(
        F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), F.md5))
    )
    return _once(leaves, _fold)


def _fold(leaves: Column) -> Column:
    above = F.transform(leaves, lambda s: F.transform(s, lambda p: F.md5(F.concat_ws("", p))))

    def top(paragraphs: Column) -> Column:
        sections = F.transform(paragraphs, lambda s: F.md5(F.concat_ws("", s)))
        return F.struct(
            F.sha2(F.concat_ws("", sections), 256).alias("root"), sections.alias("sections"), paragraphs.alias("paragraphs"), leaves.alias("leaves")
        )

    return _once(above, top)


def sketch(node: Column) -> Column:
    """The SKETCH smallest of the hashes of the tree's leaves, each occurrence its own, in order."""

    def counted(leaves: Column) -> Column:
        starts = F.transform(leaves, lambda x, i: F.when((i == 0) | (x != F.get(leaves, i - 1)), i))

        def elements(a: Column, b: Column) -> Column:
            more = lambda k: F.substring(F.md5(F.concat(F.get(leaves, a), F.lit(":"), k.cast("string"))), 1, 8)
            count, first = F.coalesce(b, F.size(leaves)) - a, F.array(F.get(leaves, a))
            return F.when(count == 1, first).otherwise(F.concat(first, F.transform(F.sequence(F.lit(2), count), more)))

        return _once(F.filter(starts, lambda i: i.isNotNull()), lambda first: F.flatten(F.zip_with(first, F.slice(first, 2, F.size(first)), elements)))

    short = F.array_sort(F.transform(F.flatten(F.flatten(node["leaves"])), lambda x: F.substring(x, 1, 8)))
    return F.slice(F.array_sort(F.array_distinct(_once(short, counted))), 1, SKETCH)


def fingerprint(node: Column) -> Column:
    """``root:paragraphs:sketch``; eight digits of each paragraph's hash, sections parted by a slash, are enough to locate an edit's paragraph."""
    short = F.transform(node["paragraphs"], lambda s: F.concat_ws("", F.transform(s, lambda p: F.substring(p, 1, 8))))
    return F.concat_ws(":", node["root"], F.concat_ws("/", short), F.concat_ws("", sketch(node)))


def likeness(a: Column, b: Column) -> Column:
    """How alike two texts are by their fingerprints, 0 to 1: the Dice coefficient of their leaves, exact up to SKETCH leaves, else estimated; 1 for equal roots.

    The share of common elements among the SKETCH smallest of both sketches estimates the Jaccard
    similarity (standard error 0.045 at most), and that gives the Dice coefficient.
    """
    x, y = (F.regexp_extract_all(F.element_at(F.split(f, ":"), 3), F.lit(".{8}"), F.lit(0)) for f in (a, b))

    def dice(pair: Column) -> Column:
        least = F.slice(F.array_sort(F.array_union(pair["x"], pair["y"])), 1, SKETCH)
        shared = F.size(F.array_intersect(F.array_intersect(pair["x"], pair["y"]), least)) / F.greatest(F.size(least), F.lit(1))
        return _once(shared, lambda j: 2 * j / (1 + j))

    return F.when(F.substring(a, 1, 64) == F.substring(b, 1, 64), F.lit(1.0)).otherwise(_once(F.struct(x.alias("x"), y.alias("y")), dice))


def differing(a: Column, b: Column) -> Column:
    """Places ``struct<section, paragraph>`` (from 0) whose hashes differ, only sections that differ being looked into."""
    sections = F.sequence(F.lit(0), F.greatest(F.size(a["sections"]), F.size(b["sections"])) - 1)
    odd = F.filter(sections, lambda i: ~F.get(a["sections"], i).eqNullSafe(F.get(b["sections"], i)))

    def inside(i: Column) -> Column:
        own, other = F.get(a["paragraphs"], i), F.get(b["paragraphs"], i)
        places = F.sequence(F.lit(0), F.greatest(F.size(own), F.size(other), F.lit(1)) - 1)
        changed = F.filter(places, lambda k: ~F.get(own, k).eqNullSafe(F.get(other, k)))
        return F.transform(changed, lambda k: F.struct(i.alias("section"), k.alias("paragraph")))

    return F.flatten(F.transform(odd, inside))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are above the key, found in two steps so that many bounds stay cheap."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    # One text literal each, folded into an array when planning: a term for each bound would make a huge plan.
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), "array<bigint>")
    table = F.from_json(F.lit(json.dumps(rows)), "array<array<bigint>>")
    # Bounds descend: the rows whose head is above the key, the last of them looked through.
    above = F.size(F.filter(heads, lambda h: h > key))
    last = F.size(F.filter(F.coalesce(F.get(table, above - 1), F.expr("CAST(array() AS array<bigint>)")), lambda b: b > key))
    return F.when(above > 0, (above - 1) * width + last).otherwise(F.lit(0)).cast("int")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, next``: each text and that of the next document by descending id; after the last comes the first.

    Ids are cut into ranges by quantiles; the next row is found inside a range by a window, and
    only the first document of each range is fetched for the range before it. So every text is
    shuffled once. A NULL text is empty, NULL ids come last, rows of one id stand in the order of
    their text's hash, and a single document is its own next.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(2**63)))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4
    found = docs.select(F.percentile_approx(F.col(f"`{id_col}`").cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    bounds = sorted(set(found or []), reverse=True)
    tie = F.xxhash64("text")
    # Rows without id are many buckets, too: by the first byte of their text's hash.
    bucket = F.when(F.col("doc_id").isNull(), len(bounds) + 129 + F.shiftright(tie, 56).cast("int")).otherwise(_bucket(key, bounds) if bounds else F.lit(0))
    rows = rows.select("doc_id", "text", key.alias("key"), tie.alias("tie"), bucket.alias("bucket"))
    order = Window.partitionBy("bucket").orderBy(F.col("key").desc(), "tie")
    inner = rows.withColumn("next", F.lead("text").over(order))
    heads = rows.groupBy("bucket").agg(F.min(F.struct(F.bitwise_not("key"), F.col("tie"))).alias("_h"), F.max("key").alias("hk"))
    heads = heads.select("bucket", "hk", F.col("_h.tie").alias("ht"))
    around = Window.orderBy("bucket")
    following = heads.select(
        F.col("bucket").alias("fb"),
        F.coalesce(F.lead("hk").over(around), F.first("hk").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("hk"),
        F.coalesce(F.lead("ht").over(around), F.first("ht").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("ht"),
    )
    texts = rows.select(F.col("key").alias("hk"), F.col("tie").alias("ht"), F.col("text").alias("head")).join(heads.select("hk", "ht"), ["hk", "ht"], "left_semi")
    texts = following.join(texts.dropDuplicates(["hk", "ht"]), ["hk", "ht"]).select("fb", "head")
    joined = inner.join(texts, (F.col("bucket") == F.col("fb")) & F.col("next").isNull(), "left")
    return joined.select("doc_id", "text", F.coalesce("next", "head").alias("next"))


def edited(text: Column, following: Column) -> Column:
    """The text whose last third (whole code points, rounded down) is replaced by as much of the beginning of another."""
    k = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - k), F.substring(following, F.lit(1), k))


def edit_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    ``near_edited`` and ``near_next`` are the likeness of the row's fingerprint to that of its edited
    text and to that of the next document. A NULL text is empty.
    """
    rows = with_next(docs, id_col, text_col).withColumn("changed", edited(F.col("text"), F.col("next")))
    rows = rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("changed", 256).alias("edited_sha256"),
        F.transform(F.array("text", "changed", "next"), lambda t: _once(tree(t), fingerprint)).alias("f"),
    )
    own, changed, following = F.col("f")[0], F.col("f")[1], F.col("f")[2]
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", own.alias("fingerprint"), changed.alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"), likeness(own, following).alias("near_next"),
    )
