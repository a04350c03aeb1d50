"""The lattice model against a sum over all segmentations, exact counts, and held-out texts."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from packetlake.llm import lattice_lm as lm

PATH = public_tokenizers.path(lm.VOCABULARY)
SCHEMA = "doc_id long, text string, word string, chunk long, c int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def every_path(word: bytes, weight: dict):
    """(probability, pieces) of each segmentation."""
    if not word:
        yield 1.0, ()
    for k in range(1, len(word) + 1):
        if word[:k] in weight:
            for p, rest in every_path(word[k:], weight):
                yield weight[word[:k]] * p, (word[:k], *rest)


def test_forward_and_expectation_equal_the_sum_over_all_segmentations():
    pieces, prior = lm.vocabulary(PATH)
    assert abs(prior.sum() - 1) < 1e-9 and (prior > 0).all()
    weight = dict(zip(pieces[:-1], prior[:-1]))
    words = ["the", "über", "日本", "a", "x\x00y", "▁b", "reading"]
    got, counts = lm.lattices(pa.array(words), lm.trie(pieces), np.log(prior), np.arange(1, len(words) + 1, dtype=float))
    want, expected = [], Counter()
    for k, w in enumerate(words):
        paths = list(every_path(lm.MARK + w.encode(), weight))
        total = sum(p for p, _ in paths)
        want.append(math.log(total))
        for p, used in paths:
            for u in used:
                expected[u] += (k + 1) * p / total
    assert np.allclose(got, want)
    assert np.allclose(counts[:-1], [expected[p] for p in pieces[:-1]])


def brute_counts(docs):
    tokens = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + [None]
    train = Counter(w for k, t in docs if k is None or zlib.crc32(str(k).encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    return {k: (k is not None and zlib.crc32(str(k).encode()) % 10 == 0, len(tokens(t)), sum(train[w] > 0 for w in tokens(t)), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for k, t in docs}


@pytest.mark.parametrize("chunk", [6 << 20, 300])
def test_counts_and_scores(spark, monkeypatch, chunk):
    monkeypatch.setattr(lm, "CHUNK", chunk)
    r = np.random.default_rng(2)
    known = ["The", "river", "and", "Über", "naïve", "house.", "日本語", "\x01"]
    docs = [(k, " ".join(r.choice(known, int(r.integers(0, 40)))) + r.choice(["", "\n", " x" * 3])) for k in range(120)]
    docs += [(120, None), (121, ""), (122, " \n"), (123, "b" * 20_000), (124, "word " * 50_000), (None, "No id")]
    df = spark.createDataFrame([(k, t, "x", 3, 4) for k, t in docs], SCHEMA).repartition(5)
    got = {x.doc_id: x for x in lm.probabilities(df, PATH).collect()}
    want = brute_counts(docs)
    for k, w in want.items():
        x = got[k]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == w[:4] and abs(x.base_score - w[4]) < 1e-6 * max(1, -w[4]), k
    assert got[120].score == got[121].score == got[122].score > got[0].score
    # the weights are those of one expectation step, and a text's score is the product over its words
    pieces, prior = lm.vocabulary(PATH)
    tree = lm.trie(pieces)
    train = Counter(w for k, t in docs if k is None or zlib.crc32(str(k).encode()) % 10 for w in re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)))
    counts = lm.lattices(pa.array(list(train)), tree, np.log(prior), np.array(list(train.values()), float))[1] + lm.PRIOR * prior
    counts[-1] += sum(k is None or zlib.crc32(str(k).encode()) % 10 > 0 for k, _ in docs)
    logp = np.log(counts / counts.sum())
    for k, t in docs[:20] + docs[123:125]:
        own = re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW))
        score = (sum(lm.lattices(pa.array(own), tree, logp)) if own else 0) + logp[-1]
        assert abs(got[k].score - score / math.log(10)) < 1e-6 * max(1, -score)


def test_repeated_rows_and_an_empty_table(spark):
    assert lm.probabilities(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    rows = lm.probabilities(spark.createDataFrame([(1, "a b", "x", 1, 1)] * 3, SCHEMA), PATH).collect()
    assert len(rows) == 3 and rows[0].train_tokens == (9 if not rows[0].held_out else 0)


def test_held_out_texts_are_likelier_than_their_scrambled_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").where("length(text) > 200").toPandas()
    r = np.random.default_rng(1)
    mixed = ["".join(r.permutation(list(t))) for t in docs.text]
    both = [(int(k), t, "x", 1, 1) for k, t in zip(docs.doc_id, docs.text)]
    held = [k for k in docs.doc_id if zlib.crc32(str(k).encode()) % 10 == 0]
    texts = dict(zip(docs.doc_id, mixed))
    fresh = [k for k in range(10**6, 2 * 10**6) if zlib.crc32(str(k).encode()) % 10 == 0][: len(held)]
    both += [(new, texts[old], "x", 1, 1) for new, old in zip(fresh, held)]
    got = {x.doc_id: x.score for x in lm.probabilities(spark.createDataFrame(both, SCHEMA), PATH).collect()}
    assert len(held) >= 10 and all(got[old] > got[new] for new, old in zip(fresh, held))
