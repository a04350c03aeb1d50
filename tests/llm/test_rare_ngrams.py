"""op7: n-grams too rare to be broadcast are joined with the whole model; none is left to the lower orders."""

import numpy as np
import pytest

from packetlake.llm import quality_rules as qr
from packetlake.llm.common import saved

WHOLE = 1 << 40


def brute(spark, docs):
    """Log-perplexity of each document by a model of all n-grams, held in one place."""
    model = qr.Model(qr.kneser_ney(saved(qr.count_ngrams(qr._folds(docs))), rare=WHOLE).toArrow())
    out = {}
    for x in qr._folds(docs).collect():
        raw = (x.text or "").encode()
        kinds, at = qr.kinds_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        out[x.doc_id] = -model.log_probability(x.own, 1 - x.fold, qr.ngram_keys(kinds, at)).mean() if len(kinds) else None
    return out


def texts(r, n):
    words = ["the", "river", "and", "house", "naïve", "über", "日本", "x1"]
    rows = [(k, " ".join(["".join(r.permutation(list(w))) if r.random() < 0.3 else w for w in r.choice(words, 40)]), r.choice(["en", "de"])) for k in range(n)]
    return rows + [(9001, None, "en"), (9002, "", None), (9003, "alone in its language", "xx"), (9004, rows[0][1], rows[0][2])]


def test_every_ngram_counts_whether_broadcast_or_joined(spark):
    docs = spark.createDataFrame([(k, t, None if x is None else str(x)) for k, t, x in texts(np.random.default_rng(4), 80)], "doc_id long, text string, lang string")
    want = brute(spark, docs)
    for rare, most in ((100, 1), (1, 10)):
        got = {x.doc_id: x.log_perplexity for x in qr.quality_rules(docs, most=most, rare=rare).collect()}
        assert got == {k: pytest.approx(v, rel=1e-4) if v is not None else None for k, v in want.items()}


def test_what_stands_once_in_millions_of_characters_counts(spark):
    r = np.random.default_rng(9)
    long = " ".join("".join(chr(97 + c) for c in w) for w in r.integers(0, 6, (700_000, 6)))  # 4.9 million characters
    rows = [(k, "%s zqxjv %d" % (long, k), "en") for k in range(2)] + [(10 + k, "zqxjv abc fed zqxjv %d" % k, "en") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    want = brute(spark, docs)
    got = {x.doc_id: x.log_perplexity for x in qr.quality_rules(docs).collect()}
    assert {k: got[k] for k in range(10, 16)} == {k: pytest.approx(want[k], rel=1e-4) for k in range(10, 16)}
