"""A corpus pipeline of five stages over documents: each stage keeps, drops or edits rows for the next one."""

from packetlake.llm import pipeline_stages as s
from packetlake.llm.common import saved, table

STAGES = [
    ("quality_classifier", s.quality),
    ("toxicity", s.toxicity),
    ("ngram_jaccard_join", s.near_duplicates),
    ("substring_dedup", s.repeated_passages),
    ("best_fit_packing", s.pack),
]

#: A trained model and a greedy packing are not SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
