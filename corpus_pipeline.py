"""Corpus preparation: quality rules, near duplicates, personal data, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but
the last return the columns of ``documents``.

Columns of the input travel in one struct, so that none can clash with a column of an
operator, whatever its name; only ``doc_id``, ``text`` and ``n_chars`` are read. Texts are
read whole at any length. An empty table gives an empty result in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshflock.llm import mixing, near_dup, packing, pii, quality
from meshflock.llm.queries import tokenizer_files
from meshflock.runtime import discard, materialize


def boxed(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), *more)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    Null and empty texts have no words and go, as all that the base rules fail. Repeated rows
    get equal verdicts; a posterior of exactly the threshold keeps a document."""
    voted = quality.with_votes(quality.signals(boxed(docs, F.col("text"))).drop("text"))
    voted = materialize(voted, "voted")  # signals are computed once, for the fit and for the verdicts
    model = quality.fit(materialize(quality.patterns(voted), "patterns"))
    return quality.judged(voted, model).where("kept").select("_doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group stays.

    Rows with one id are one document: of its rows with equal texts the first stays, by the
    order of all its values. Rows without an id, and empty and null texts, have no
    duplicates."""
    groups = near_dup.group(docs.select("doc_id", "text")).where("doc_id is not null")
    groups = materialize(groups.groupBy(F.col("doc_id").alias("doc")).agg(F.max("kept").alias("kept"), F.count("*").alias("n")), "groups")
    # rows of ids that go, or that occur more than once, are looked up; all others, most by far, pass where they are read
    doubtful = spark.sparkContext.broadcast(near_dup.spot_filter(groups.where("not kept or n > 1")))
    rows = boxed(docs, F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    rows = rows.withColumn("_look", near_dup.spotted(F.col("_id"), doubtful))
    same = Window.partitionBy("_id", "_text").orderBy(F.to_json("_doc"))
    looked = rows.where("_look").join(groups.where("kept").select(F.col("doc").alias("_id")), "_id", "left_semi")
    one = looked.withColumn("_nth", F.row_number().over(same)).where("_nth = 1")
    return one.select("_doc").union(rows.where("not _look").select("_doc")).select("_doc.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data, also in disguise, is replaced by its kind; ``n_chars`` follows.

    Rows are masked one by one; null texts stay null, and a text without finds stays as it is."""
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in rest]).alias("_doc"), F.col("text").alias("_source"))
    found = pii.find(rows, "_source")

    def column(c: str):
        old = F.col("_doc").getField(c) if c != "text" else None
        if c == "text":
            return F.col("masked").alias(c)
        return F.coalesce(F.length("masked").cast(docs.schema[c].dataType), old).alias(c) if c == "n_chars" else old.alias(c)

    return found.select(*[column(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are dropped or repeated at their fitted rates.

    Rows with one id get the largest number of copies of any of them; rows without an id stay
    once. Null and empty texts hold no tokens and are mixed by the shares of the classes. A
    domain that cannot reach its target is told by a warning."""
    labels = mixing.domain_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    # the classifier's sample is bounded by labels: only those of rows that are still here count
    labels = materialize(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), "labels")
    rates = mixing.mix(docs.select("doc_id", "text"), labels, mixing.TARGETS, mixing.BUDGET)
    times = rates.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").alias("_copies"))
    # rows of ids that go or repeat are looked up; all others, most by far, pass where they are read
    times = materialize(times.where("_copies <> 1"), "times")
    changed = spark.sparkContext.broadcast(near_dup.spot_filter(times.select(F.col("_id").alias("doc"))))
    rows = boxed(docs, F.col("doc_id").cast("long").alias("_id"))
    rows = rows.withColumn("_look", near_dup.spotted(F.col("_id"), changed))
    looked = rows.where("_look").join(times, "_id", "left").withColumn("_copies", F.coalesce("_copies", F.lit(1)))
    some = looked.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return some.select("_doc").union(rows.where("not _look").select("_doc")).select("_doc.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens. Null and empty texts are one closing token; repeated
    rows are packed as separate pieces."""
    pieces = materialize(packing.tokenize(docs, *tokenizer_files()), "pieces")
    return packing.pack(pieces)


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("personal data", personal_data), ("mixture", mixture), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return docs
