"""The training-corpus pipeline: documents in, a decontaminated mix out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderloom.llm import decontaminate, language_id, mixing, near_dedup, quality
from cinderloom.llm._shared import crc_mod, free_name, load, written

REJECT_BELOW = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier does not find likelier bad than good (score below REJECT_BELOW).

    A null or empty text gets what the curve says of no difference, and stays or goes by that; very long texts are scored whole; repeated
    rows and ties share a score, so all stay or all go; rows without doc_id are scored, but never learnt from; a
    column named like the score is kept; an empty table gives no rows. Without labels nothing is told apart and all rows score 0.5 and stay.
    """
    model = quality.fit(docs, load(spark, sf_dir, "labels"), learn=F.expr(crc_mod("doc_id", 4)) != 2)
    name = free_name(docs, "quality_score")
    return quality.scored(docs, model, name=name).filter(F.col(name) >= REJECT_BELOW).drop(name)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter or far from every language go.

    Null and empty texts have no letter and go; very long texts are counted whole; repeated rows share a result; rows without doc_id
    or lang are judged like others; columns named like the results are kept; an empty table gives no rows. Where no row has a language
    nothing is recognised and no row stays.
    """
    model = language_id.fit(docs, learn=F.expr(crc_mod("doc_id", 3)) != 1)
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_rejected"))
    return language_id.identify(docs, model, names=names).filter(~F.col(names[2])).drop(*names)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least doc_id; one without doc_id only where none has one.

    A document is a doc_id and a text: rows of one doc_id whose texts differ are looked at apart, the least md5 first, and rows
    without doc_id are documents by their texts. Rows that share both are one document, the row that is least by its columns in order. Null, empty and
    wordless texts are each a class of its own (of rows without doc_id one null and one empty text stays); very long texts are compared whole; columns of
    any name are kept; an empty table gives no rows.
    """
    mark, node = free_name(docs, "print"), free_name(docs, "node")
    md5 = F.coalesce(F.md5(F.col("text").cast("binary")), F.lit("")).alias(mark)
    known, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    prints = known.select("doc_id", md5)
    first = prints.groupBy("doc_id").agg(F.min(mark).alias("first"), F.max(mark).alias("last"), F.count(F.lit(1)).alias("k"))
    shared = written(first.filter("k > 1"), "shared")
    several = shared.filter("first <> last").select("doc_id", "first")
    further = prints.join(several, "doc_id").filter(F.col(mark) != F.col("first")).select("doc_id", mark).distinct()
    # Further texts of a doc_id and texts without one get numbers below all ids; too small an id for that is an overflow error.
    least = known.agg(F.least(F.min("doc_id"), F.lit(0)).cast("long")).first()[0] or 0
    further = further.unionByName(nameless.select("doc_id", md5).distinct())
    further = written(further.withColumn(node, F.lit(least) - 1 - F.monotonically_increasing_id()), "further")

    named = known.withColumn(mark, md5).join(further.filter("doc_id is not null"), ["doc_id", mark], "left").withColumn(node, F.coalesce(node, "doc_id"))
    # A text that a third of the rows without doc_id share is one row of the right side, and AQE may split the left.
    unnamed = nameless.withColumn(mark, md5).join(further.filter("doc_id is null").select(mark, node), mark)
    texts = named.select(F.col(node).alias("doc_id"), "text").unionByName(unnamed.groupBy(F.col(node).alias("doc_id")).agg(F.first("text").alias("text")))
    classes = written(near_dedup.near_duplicates(texts).select("doc_id", "class_id"), "classes")
    own = classes.select(F.col("doc_id").alias("n"), "class_id").join(further.select(F.col(node).alias("n"), F.col("doc_id"), mark, F.lit(True).alias("more")), "n", "left")
    # Documents with an id come before those without one.
    of_text = F.col("more").isNotNull() & F.col("doc_id").isNull()
    order = F.struct(of_text.alias("nameless"), F.when(~of_text, F.coalesce("doc_id", "n")).alias("id"), F.coalesce(mark, F.lit("")).alias("print"), "n")
    stay = own.groupBy("class_id").agg(F.min(order).alias("best")).select(F.col("best.n").alias("n"))
    gone = written(classes.select(F.col("doc_id").alias("n")).distinct().join(stay, "n", "left_anti").withColumnRenamed("n", node), "duplicates")
    kept = named.join(gone, node, "left_anti")
    # Only rows whose doc_id comes again, or that have none, can repeat a document; the others are not shuffled for it.
    again = kept.join(shared.select("doc_id"), "doc_id", "left_semi").unionByName(unnamed.join(gone, node, "left_anti"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = again.groupBy(node).agg(F.min(row).alias("row")).select("row.*")
    alone = kept.join(shared.select("doc_id"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(once)


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their benchmark passages; documents that are mostly benchmark go.

    Null and empty texts have no words and stay as they are; very long texts are cut whole; repeated rows are each cut
    alike, rows without doc_id like others; columns named like the operator's are kept, n_chars of a text that was cut is
    counted again; an empty table gives no rows, an empty benchmark leaves all as it is.
    """
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text", "dropped")
    prefix = "dc_"
    while {f"{prefix}{n}" for n in names} & {c.lower() for c in docs.columns}:
        prefix += "_"
    out = decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"), prefix=prefix)
    clean, hit = F.col(f"{prefix}clean_text"), F.col(f"{prefix}contaminated")
    out = out.filter(~F.col(f"{prefix}dropped"))
    changed = {"text": clean, "n_chars": F.when(hit, F.length(clean).cast("long")).otherwise(F.col("n_chars"))}
    return out.withColumns({c: v for c, v in changed.items() if c in docs.columns}).select(*[F.col(f"`{c}`") for c in docs.columns])


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: rows with the words taken of them (repeats counted) beside the columns of documents.

    Null, empty and wordless texts have no words and are not taken; a null source is a source, the last; rows without
    doc_id, and rows that repeat one, share a rank and are taken while each fits; columns named like the results are replaced; an empty
    table gives no rows. Very long documents are taken whole or not at all.
    """
    return mixing.mixed(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_dedup", one_of_each),
    ("decontaminate", no_benchmark),
    ("mix", target_mix),
]

#: SQL cannot express the classifiers and the signatures; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written to the shared folder and read again."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
