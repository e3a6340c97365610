"""From raw documents to token ids: the stages, and the run over the documents of a folder.

Each stage takes ``(spark, docs, sf_dir)``; its result is written and read again as the next one's
documents. All but the last return the columns of the documents they get.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import marked, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5 stay. The model learns from the folder's labels of these documents."""
    from newsloom.llm.toxicity import score, train

    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    mark = max(docs.columns, key=len) + "_toxicity"  # longer than any name the documents have
    return score(docs, model, docs.columns, name=mark).where(F.col(f"`{mark}`") < 0.5).drop(mark)


def minhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (0.8 and more) the document with the smallest id stays.

    Rows that share an id are one document and stay or go together; rows without id stay.
    """
    from newsloom.llm.minhash import near_duplicates

    gone = near_duplicates(docs, threshold=(4, 5)).where("NOT kept").select(F.col("doc_id").alias("_gone"))
    # Few documents go; only those that may be among them are shuffled to be looked up.
    mark = max(docs.columns, key=len) + "_may"  # longer than any name the documents have
    met = marked(docs, F.col("doc_id").cast("long"), gone, mark)
    rest, some = met.where(~F.col(f"`{mark}`")).drop(mark), met.where(F.col(f"`{mark}`")).drop(mark)
    return rest.union(some.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti"))


def passages_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand twice in what is left are cut out of the texts; all documents stay.

    A character the cut goes through is dropped, ``n_chars`` follows the new text.
    """
    from newsloom.llm.suffix import cut_repeats

    cut = cut_repeats(docs, docs.columns, characters=True)
    # By place, since the documents may have columns of the names that are added.
    places = [f"c{i}" for i in range(len(cut.columns))]
    text = F.col(places[-1]).cast("string")
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return cut.toDF(*places).select(*[new.get(c, F.col(p)).alias(c) for c, p in zip(docs.columns, places, strict=False)])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, as often as the weights of their sources ask for (0 to 3 times)."""
    from newsloom.llm.mixing import mixed

    return mixed(docs)


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text: ``doc_id, source, n_tokens, ids`` and the hash of the decoded text."""
    import public_tokenizers

    from newsloom.llm.bpe import encode

    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "source"], ["n_tokens", "ids", "decoded_sha256"])


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", minhash_stage),
    ("repeated passages", passages_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

# No SQL can express the learned score of the first stage; the tests follow each stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of a folder: ``doc_id, source, n_tokens, ids, decoded_sha256`` of what is left.

    NULL texts, sources and ids pass through every stage as they are described there; an empty table
    gives no rows, and columns the documents have beside the usual ones are carried up to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
