"""From documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as Parquet, and judges it by itself. All but the
last return the columns of documents, whatever other columns there are and whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import language, mixing, ngram_join, packing, tokens, toxicity
from tideline.llm.common import settled, table
from tideline.llm.queries import VOCABULARY
from tideline.operators.joins import join_keyed

#: A document of at least this posterior is in a known language.
LANGUAGE_LEAST = 0.5
#: A document of at least this score is toxic.
TOXIC = 0.7
#: Bytes of texts that travel to a Python worker at a time. Spark's own bound is 10,000 rows or 64 MB, of which
#: executor and worker hold several copies for each task.
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session, also for the rows a stage returns, which are computed later.

    Only how many rows travel together changes: every row still does.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def whole(docs: DataFrame) -> Column:
    """A row as one value: what a stage adds beside it can have any name, also one of a column."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("doc")


def numbered(docs: DataFrame) -> DataFrame:
    """The rows as ``doc``, written with a number ``row`` each: ids may be null or occur more than once."""
    return settled(docs.select(whole(docs), F.monotonically_increasing_id().alias("row")))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in one of the labelled languages; without letters or in doubt they go.

    Null, empty and letterless texts go. Repeated rows stay or go together; an empty table stays empty.
    """
    small_batches(spark)
    scored = language.identify(docs.select(whole(docs), "text"), language.fit(docs))
    good = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LANGUAGE_LEAST)
    return scored.where(good).select("doc.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents scored under the limit; all labelled rows among them teach.

    Null and empty texts are judged by the bias. Repeated rows stay or go together; an empty table
    stays empty.
    """
    small_batches(spark)
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(whole(docs), "text"), model).where(F.col("score") < TOXIC).select("doc.*")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near copies: of least id, null last. Rows without words stay."""
    small_batches(spark)
    rows = numbered(docs)
    groups = ngram_join.join(rows.select(F.col("row").alias("doc_id"), "doc.text")).select(
        F.col("doc_id").alias("row"), "component_id")
    rank = F.struct(F.col("doc.doc_id").isNull().alias("none"), "doc.doc_id", F.xxhash64("doc.text").alias("text"), "row")
    ranked = rows.select("row", rank.alias("rank")).join(groups, "row")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("rank")).select("rank.row")
    return join_keyed(rows, first, ["row"], "left_semi").select("doc.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in as many copies as the mix takes of each: 0, 1 or 2. Rows without words have none."""
    small_batches(spark)
    rows = numbered(docs)
    sized = rows.select("row", "doc.doc_id", "doc.text", "doc.source")
    copies = mixing.mix(sized, keep=["row"]).where("copies > 0").select("row", "copies")
    return join_keyed(rows, copies, ["row"], "inner").select(
        "doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("doc.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their place in a sequence; each copy of a document is cut for itself.

    A null text is empty and gives the end id alone; other columns than id and text are left out.
    """
    small_batches(spark)
    cut = tokens.pieces(docs, VOCABULARY, end_id=1, longest=2048)
    return packing.pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), ["doc_id", "start"])


STAGES = [
    ("language ID", known_language),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", one_of_near_copies),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]
#: Trained models and the tokenizer have no SQL form; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
