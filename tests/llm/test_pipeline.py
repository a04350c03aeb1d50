"""The pipeline's stages take effect, and the registered queries cover all ten operators."""

import re
from collections import defaultdict

import corpus_pipeline
from packetlake.llm import queries
from packetlake.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_ten_queries_and_oracles():
    assert [re.match(r"op(\d+)_", n)[1] for n in queries.MODULES] == [str(k) for k in range(1, 11)]
    assert set(queries.oracle_sql()) <= set(queries.queries())


def test_stages_take_effect(spark):
    docs = table(spark, SF, "documents")
    columns, rows = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF))
        if name != "best_fit_packing":
            assert out.columns == columns
            rows[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    every = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    good = {d for d, r in labels.items() if r.quality == 1 and d in every}
    assert len(good & set(rows["quality_classifier"])) >= 0.95 * len(good)
    assert set(rows["ngram_jaccard_join"]) <= set(rows["toxicity"]) <= set(rows["quality_classifier"]) <= set(every)
    left = rows["substring_dedup"]
    assert set(left) == set(rows["ngram_jaccard_join"])
    seen = defaultdict(set)
    for d, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(w) - 49):
            seen[tuple(x.lower() if x.isascii() else x for x in w[k : k + 50])].add(d)
    assert not [k for k, v in seen.items() if len(v) > 1]
    packed = docs.collect()
    assert {r.doc_id for r in packed} == set(left) and max(r.offset + r.length for r in packed) <= 2048


def test_stages_on_odd_rows(spark):
    """Equal rows, several texts of a doc_id, rows without doc_id or text, clashing extra columns, and an empty table."""
    long = " ".join(f"word{k % 977}x{k}" for k in range(200_000))
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A b c d e f g h"), (3, None), (None, "a b c d e f g h"), (4, ""), (5, long), (3, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 0, "p", 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, piece string, _spans int")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
        out = stage(spark, docs, SF)
        got = sorted((r.doc_id or 0) for r in out.select("doc_id").distinct().collect())
        if name == "ngram_jaccard_join":
            assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 1, 3, 4, 5] and out.columns == docs.columns
        elif name == "best_fit_packing":
            assert got == [0, 1, 2, 3, 4, 5]
        else:
            assert out.columns == docs.columns
        if name == "substring_dedup":
            assert out.count() == len(rows) and {r.text for r in out.where("doc_id = 5").collect()} == {long}
