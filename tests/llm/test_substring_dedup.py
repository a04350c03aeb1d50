import numpy as np
import pytest

from packetlake.llm import substring_dedup as sd


def words(rng, n, tag):
    return [f"{tag}{k}x" for k in rng.integers(0, 1_000_000, n)]


def hashes(text):
    raw = " ".join(text).encode()
    return sd.sequence(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]


def seeds(ha, hb):
    """All seeds of two texts: every two windows of one hash function with the same minimum."""
    out = []
    for f in range(sd.HASHES):
        va, vb = sd.tv.mix(ha, 200 + f), sd.tv.mix(hb, 200 + f)
        of = {}
        for l, c, r in sd.compact_windows(va):
            of.setdefault(int(va[c]), []).append((l, c, r))
        out += [(f, *x, *y) for y in sd.compact_windows(vb) for x in of.get(int(vb[y[1]]), ())]
    return np.array(out, np.int64).reshape(-1, 7)


def test_regions_are_the_components_of_all_meeting_seeds():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 40))
        la, lb = rng.integers(0, 120, n), rng.integers(0, 120, n)
        ra, rb = la + rng.integers(0, 30, n), lb + rng.integers(0, 30, n)
        s = np.column_stack([rng.integers(0, 4, n), la, la, ra, lb, np.arange(n), rb])
        meet = (la[:, None] <= ra) & (ra[:, None] >= la) & (lb[:, None] <= rb) & (rb[:, None] >= lb)
        for _ in range(6):
            meet = (meet.astype(int) @ meet.astype(int)) > 0
        want = {tuple(np.flatnonzero(row)) for row in meet}
        assert {tuple(sorted(g[5])) for g in sd.supported(s, 1)} == want


def test_a_passage_that_stands_often_in_a_long_text_is_found_each_time():
    rng = np.random.default_rng(2)
    passage = words(rng, 60, "p")
    a = words(rng, 300, "a") + passage + words(rng, 300, "a")
    b, begins = words(rng, 600, "b"), []
    for _ in range(30):
        begins.append(len(b))
        b += passage + words(rng, 600, "b")
    ha, hb = hashes(a), hashes(b)
    found = [x for g in sd.supported(seeds(ha, hb)) for x in sd.passages(ha, hb, g)]
    assert {p for p in begins if any(s <= p and e >= p + 55 for s, e, _ in found)} == set(begins)


def uncovered(texts, found):
    """(document, place) of the runs of 50 words that an earlier document has and no passage covers."""
    cover = {}
    for f in found:
        cover.setdefault(f.doc_id, set()).update(range(f.start_word, f.end_word))
    seen, out = {}, []
    for k, t in enumerate(texts):
        for s in range(len(t) - 49):
            if seen.setdefault(tuple(t[s : s + 50]), k) != k and not set(range(s, s + 50)) <= cover.get(k, set()):
                out.append((k, s))
    return out


def test_passages_of_lines_that_the_first_and_last_documents_hold_singly(spark):
    rng = np.random.default_rng(6)
    ends, middle = [], []
    for k in range(40):
        cuts = [[30, 30], [20, 20, 20], [15, 15, 15, 15], [45]][k % 4]
        lines = [words(rng, n, "q") for n in cuts]
        ends.append([words(rng, 60, "e") + line + words(rng, 60, "e") for line in lines])
        passage = sum(lines, []) + (words(rng, 15, "o") if len(cuts) == 1 else [])
        middle += [words(rng, 80, "m") + passage + words(rng, 80, "m") for _ in range(2)]
    first = [t for e in ends for t in e]
    texts = first + middle + [words(rng, 60, "z") + t[60:-60] + words(rng, 60, "z") for t in first]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = sd.repeated_passages(docs).collect()
    lost = {k for k, _ in uncovered(texts, found)}
    print("pairs lost", len(lost), "of 40")
    assert not lost
    assert all(f.n_words >= 50 for f in found)


def near_copies():
    """(name, a, b, first and last shingle of the copy in b)."""
    for k in range(20):
        rng = np.random.default_rng(100 + k)
        p = words(rng, 80, "p")
        around = [words(rng, 40, "w") for _ in range(4)]
        changed = p[:40] + words(rng, 1, "c") + p[41:]
        kinds = {"clause": (p, p[:40] + words(rng, 10, "i") + p[40:]), "word": (p, changed), "two clauses": (words(rng, 0, "p") + p + p[::-1], p[:30] + words(rng, 9, "i") + p[30:] + p[::-1])}
        early = p[44:49]
        kinds["earlier shingle"] = (p, p[:46] + words(rng, 1, "c") + p[47:])
        for name, (x, y) in kinds.items():
            head = around[0] + (p[10:15] + around[3] + p[60:65] + early if name == "earlier shingle" else [])
            b = around[1] + y + around[2]
            yield name, head + x + around[3], b, 40, 40 + len(y) - sd.WIDTH


def test_near_copies_with_clauses_and_other_words_are_whole():
    lost = {}
    for name, a, b, first, last in near_copies():
        ha, hb = hashes(a), hashes(b)
        sa, sb = set(ha[40:-40].tolist()) if name != "earlier shingle" else set(ha[-120:-40].tolist()), set(hb[first : last + 1].tolist())
        where = [k for k in range(len(ha)) if ha[k] in sb]
        seed = [k for k in where if k >= len(ha) - 40 - len(sa)][0]
        region = (0, len(ha) - 1, 0, len(hb) - 1, [seed], [int(np.flatnonzero(hb == ha[seed])[0])])
        found = sd.passages(ha, hb, region)
        for s, e, _ in found:
            assert e - s + 1 >= sd.LEAST
        if not any(s <= first and e >= last for s, e, _ in found):
            lost[name] = lost.get(name, 0) + 1
    print("lost", lost)
    assert not lost


def test_near_passages_are_found_between_first_and_last_documents_with_scraps_of_them(spark):
    """Passages of 60 to 100 words with one or two other words, whose shingles also stand alone in other documents."""
    rng = np.random.default_rng(8)
    first, middle, last = [], [], []
    for k in range(60):
        p = words(rng, 60 + k % 41, "p")
        q = list(p)
        for at in rng.choice(np.arange(5, len(p) - 5), 1 + k % 2, replace=False):
            q[at] = words(rng, 1, "c")[0]
        middle += [words(rng, 70, "m") + x + words(rng, 70, "m") for x in (p, q)]
        scraps = [x[s : s + 7] for x in (p, q) for s in range(0, len(p) - 7, 7)]
        for ends in (first, last):
            ends.append(words(rng, 20, "s") + [w for s in scraps for w in s + words(rng, 20, "s")])
    texts = first + middle + last
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {(f.dup_of, f.doc_id): f for f in sd.repeated_passages(docs).collect()}
    pairs = [(60 + 2 * k, 61 + 2 * k) for k in range(60)]
    alike = []
    for k, pair in enumerate(pairs):
        x, y = (set(hashes(texts[d][70:-70]).tolist()) for d in pair)
        alike.append(100 * len(x & y) >= 75 * len(x | y))
    got = [pair in found for pair, ok in zip(pairs, alike) if ok]
    print("near passages found", sum(got), "of", len(got))
    assert sum(got) >= 0.95 * len(got) and len(got) > 40
    assert set(found) <= set(pairs)


@pytest.mark.parametrize("part", [30, 40, 49])
def test_near_passages_are_found_behind_documents_that_hold_a_part_of_them(spark, part):
    """80 words and a copy with one other word; each earlier document holds `part` words of one of them, which is no passage."""
    rng = np.random.default_rng(part)
    first, middle = [], []
    for _ in range(30):
        p = words(rng, 80, "p")
        q = list(p)
        q[int(rng.integers(10, 70))] = words(rng, 1, "c")[0]
        first += [words(rng, 60, "s") + x[s : s + part] + words(rng, 60, "s") for x in (p, q) for s in range(0, 81 - part, 10)]
        middle += [words(rng, 60, "m") + x + words(rng, 60, "m") for x in (p, q)]
    texts = first + middle
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").repartition(6)
    found = {(f.dup_of, f.doc_id) for f in sd.repeated_passages(docs).collect()}
    got = [(len(first) + 2 * k, len(first) + 2 * k + 1) in found for k in range(30)]
    print("near passages found", sum(got), "of 30")
    assert sum(got) >= 29
    assert all(a >= len(first) for a, _ in found)


def test_several_texts_of_one_document(spark):
    rng = np.random.default_rng(9)
    p = words(rng, 80, "p")
    rows = [(1, " ".join(p)), (2, " ".join(words(rng, 30, "a") + p)), (2, "short text"), (2, " ".join(words(rng, 30, "a") + p)), (3, None), (None, " ".join(p))]
    docs = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, _spans string, start_word int")
    out = sd.remove_repeats(docs, sd.repeated_passages(docs)).collect()
    assert len(out) == len(rows) and out[0].asDict().keys() == {"doc_id", "text", "_spans", "start_word"}
    assert sorted(r.text or "" for r in out if r.doc_id not in (2,)) == sorted([rows[0][1], "", rows[5][1]])
    assert {"short text"} <= {r.text for r in out if r.doc_id == 2}


def test_empty_table(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").where("false")
    found = sd.repeated_passages(docs)
    assert found.count() == 0 and sd.remove_repeats(docs, found).count() == 0


def test_minima_of_runs_are_found_without_the_whole_of_each_run(monkeypatch):
    rng = np.random.default_rng(3)

    def whole(*_, **__):
        raise AssertionError("each run is laid out whole")

    for kinds in (9, 200, 10**12):
        at = np.cumsum([0, 400, 46, 30, 700])
        h, v = (rng.integers(0, kinds, at[-1]).astype(np.uint64) for _ in range(2))
        flag = v % np.uint64(5) == 0
        want = [[(d, p) for p in range(e - s - 45) if flag[s + p + int(v[s + p : s + p + 46].argmin())]] for d, (s, e) in enumerate(zip(at, at[1:]))]
        with monkeypatch.context() as m:
            m.setattr(np.lib.stride_tricks, "sliding_window_view", whole)
            key, place, home = sd.run_keys(h, v, flag, at)
        assert list(zip(home.tolist(), place.tolist())) == sum(want, [])
        assert key.tolist() == [int(sd.run_hashes(h[at[d] : at[d + 1]])[p]) & ~1 for d, p in zip(home, place)]
        s, e = at[0], at[1]
        one = [sum(1 for q in range(s, e) if q <= c and min(v[q : c + 1]) == v[c] and (v[q:c] > v[c]).all()) + sum(1 for q in range(c + 1, e) if (v[c + 1 : q + 1] > v[c]).all()) >= 46 for c in range(s, e)]
        assert sd.least_around(v, np.arange(s, e), np.full(e - s, s), np.full(e - s, e)).tolist() == one
