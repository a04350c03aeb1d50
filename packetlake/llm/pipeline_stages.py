"""The stages of corpus_pipeline.py: (spark, docs, sf_dir) -> DataFrame.

Edge cases: null and empty texts are scored like any other, are near copies of nothing, have no passage and pack as the end
token alone; ties of scores fall alike, as each row is judged by itself; of equal rows (one doc_id, one text) the near
copies' stage keeps one, and rows of one doc_id with other texts stay unless the doc_id is a copy of a smaller one; rows
without doc_id stay in every stage; empty tables pass through; extra columns are kept up to the last stage, whatever
their names; texts of any length are read whole.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, saved, table


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects (score under 0.3). It learns from the labelled rows of `documents`."""
    from . import quality_classifier as q

    model = q.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id() % 5 != 0)
    return q.filter_by(docs, q.scorer(model), lambda s: s >= 0.3)


def toxicity(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that score 0.7 or more."""
    from . import toxicity as t
    from .quality_classifier import filter_by

    model = t.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_of_id() % 3 != 1)
    return filter_by(docs, t.scorer(model), lambda s: s < 0.7)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest doc_id, of each group of near copies."""
    from . import ngram_join as n

    found = n.near_duplicate_components(docs)
    drop = F.max(F.col("doc_id") != F.col("component_id")).alias("_drop_")
    of = saved(found.where("doc_id is not null").groupBy(F.col("doc_id").alias("_id_")).agg(drop, (F.count("*") > 1).alias("_more_")).where("_drop_ or _more_"))
    rows = docs.join(of, F.col("doc_id").cast("long") == F.col("_id_"), "left").where("not coalesce(_drop_, false)")
    again = rows.where("_more_").select(docs.columns).dropDuplicates(["doc_id", "text"])
    return rows.where("_more_ is null").select(docs.columns).unionByName(again)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that repeat from all but one of the documents that hold them."""
    from . import substring_dedup as d

    return d.remove_repeats(docs, saved(d.repeated_passages(docs)))


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack_documents(docs)
