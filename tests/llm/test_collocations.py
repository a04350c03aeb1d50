"""Collocations against exact counts in plain Python, on small fixtures."""

import random
import re
from collections import Counter

import pytest

from packetlake.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, rank long, f long, k int"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, top):
    counts, totals = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        own = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, own in counts.items():
        rows, often = [], {p: f for p, f in own.items() if 2 <= len(p) and f >= least}
        for p, a in often.items():
            inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: E731, B023
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in often.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (own[p[:k]] + own[p[k:]]), k, own[p[:k]], own[p[k:]]) for k in range(1, len(p)))
            rows.append((" ".join(p), a, l, r, totals[lang], score))
        rows.sort(key=lambda x: (-x[5], -x[1], x[0].encode()))
        out += [(lang, k + 1, *x) for k, x in enumerate(rows[:top])]
    return sorted(out)


def texts(r):
    words = ["New", "york", "city", "é", "a", "b\x01", "ß", "the", "日本", "x\x00"] + [f"w{k}" for k in range(30)]
    out = []
    for k in range(300):
        text = ""
        for _ in range(r.randint(0, 60)):
            text += r.choice(["new york city ", "the a ", "a b\x01 ", "of the new york ", *(r.choices(words)[0] + " " for _ in range(6))])
            text += r.choice(["", "", "", ", ", "\t", ".\n", " \x0b", "? "])
        out.append((text, r.choice(["en", "en", "de", None, "und"])))
    return out + [(None, "en"), ("", "fr"), (" \n", None), ("new york " * 30_000, "en"), ("new york", "zz")] + [("hot phrase here now", "hot")] * 200


@pytest.mark.parametrize("piece, partitions", [(6 << 20, 3), (2000, 9)])
def test_equals_plain_counting(spark, monkeypatch, piece, partitions):
    monkeypatch.setattr(co, "PIECE", piece)
    docs = texts(random.Random(partitions))
    df = spark.createDataFrame([(k, t, lang, "x", 1, 2, 3) for k, (t, lang) in enumerate(docs)], SCHEMA).repartition(partitions)
    got = sorted(map(tuple, co.collocations(df, 20, 50).collect()))
    assert got == brute(docs, 20, 50)


def test_a_language_of_saturated_bit_map_gives_the_same(spark, monkeypatch):
    monkeypatch.setattr(co, "BITS", 1 << 10)
    docs = texts(random.Random(3))
    df = spark.createDataFrame([(k, t, lang, "x", 1, 2, 3) for k, (t, lang) in enumerate(docs)], SCHEMA)
    assert sorted(map(tuple, co.collocations(df, 5, 2000).collect())) == brute(docs, 5, 2000)


def test_first_parts_pass_from_range_to_range(spark):
    """Ranges that begin inside a phrase's extensions: 60 ranges over 200 phrases."""
    rows = [("en", ["a"], 1000)] + [("en", ["a", f"{k:03d}"], 500 - k) for k in range(100)] + [("en", ["a", f"{k:03d}", "b"], 90) for k in range(0, 100, 2)] + [("en", ["b"], 7), ("fr", ["a"], 5)]
    stream = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    spark.conf.set("spark.sql.shuffle.partitions", "30")
    try:
        got = {(r.lang, *r.words): r.heads for r in co.with_parts(stream, "words", "heads").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = {(lang, *w): f for lang, w, f in rows}
    assert got == {p: [want[p[:k]] for k in range(2, len(p))] for p in want}


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
