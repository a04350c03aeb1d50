"""The ten operators against brute force, exact round trips or held-out labels, on small fixtures and their edge cases."""

import base64
import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetlake.llm import bpe, html_extract, ngram_join, packing, quality_classifier, quality_rules, sharding, substring_dedup, textvec, toxicity, vector_dedup

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, a string, key long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(k, t, "en" if k % 3 else None, None, len(t or ""), "x", k) for k, t in enumerate(texts)], schema)


def sentence(r, n):
    return " ".join("".join(r.choice(list("abcdefgh"), 4)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages, hot groups, and texts without words."""
    r = np.random.default_rng(1)
    base = [sentence(r, int(n)) for n in r.integers(1, 400, 40)]
    passage = sentence(r, 60)
    texts = [None, "", " \n\t", "one", "one two", "One two", " ", "é è", *base]
    for k in range(60):  # near copies of one text, and copies of another
        w = base[5].split() + ["w"] * 60
        w[int(r.integers(len(w)))] = f"n{k}"
        texts += [" ".join(w), base[7]]
    for k in range(30):
        texts.append(f"{sentence(r, int(r.integers(5, 90)))} {passage} {sentence(r, 20)}")
    texts.append(" ".join([sentence(r, 8)] * 300))
    return texts


def brute_components(texts):
    sets = []
    for t in texts:
        w = words((t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i + 1, len(sets)):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [len(s) for s in sets], [find(k) for k in range(len(texts))]


def test_ngram_join_is_exact(spark, corpus):
    sizes, comps = brute_components(corpus)
    got = {r.doc_id: r for r in ngram_join.near_duplicate_components(frame(spark, corpus)).collect()}
    assert [got[k].n_shingles for k in range(len(corpus))] == sizes
    assert [got[k].component_id for k in range(len(corpus))] == comps


def test_ngram_join_empty(spark):
    assert ngram_join.near_duplicate_components(frame(spark, ["a"]).where("false")).count() == 0


def test_trees_alone_find_the_same(spark, corpus):
    """Without hubs, and with long lists cut into parts, the trees find every link."""
    sizes, comps = brute_components(corpus)
    docs = frame(spark, corpus)
    for hubs, leaf in ((False, 4096), (False, 20), (True, 20)):
        got = {r.doc_id: r.component_id for r in ngram_join.near_duplicate_components(docs, hubs=hubs, leaf=leaf).collect()}
        assert [got[k] for k in range(len(corpus))] == comps, (hubs, leaf)


def test_trees_make_the_candidates_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = ngram_join.prints_and_counts(docs)
    often = spark.sparkContext.broadcast(ngram_join.frequent_buckets(both.where("k is not null").select("k", "counts")))
    heads = both.where("k is null and n > 0").groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "f1", F.col("doc_id").alias("comp"))
    pairs = ngram_join.list_pairs(ngram_join.list_rows(ngram_join.signatures(docs, often), heads)).distinct()
    with_hubs = ngram_join.near_duplicate_components(docs).where("class_id <> component_id").count()
    assert pairs.count() >= with_hubs > 0


def test_tree_bounds_lose_nothing():
    r = np.random.default_rng(3)
    vec = r.poisson(3, (300, 16))
    vec[100:200] = vec[:100] + r.integers(0, 2, (100, 16))
    vec[200:210] = vec[200]
    n, comp, group = vec.sum(1), np.arange(300), np.repeat([0, 1, 2, 3], [1, 9, 199, 91])
    trees = ngram_join.RTrees(group, n, comp, vec)
    found = list(zip(*trees.join(trees)))
    got = {(min(p, q), max(p, q)) for p, q in found}
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if group[i] == group[j] and ngram_join.may_link(n[i], n[j], np.minimum(vec[i], vec[j]).sum())}
    assert len(found) == len(got) and got == want
    two = ngram_join.RTrees(group[150:], n[150:], comp[150:], vec[150:])
    one = ngram_join.RTrees(group[:150], n[:150], comp[:150], vec[:150])
    assert {(p, q + 150) for p, q in zip(*one.join(two))} == {(i, j) for i, j in want if i < 150 <= j}


def test_repeated_passages_are_all_found(spark, corpus):
    docs = frame(spark, corpus)
    found = substring_dedup.repeated_passages(docs).collect()
    cover = defaultdict(set)
    for f in found:
        assert f.dup_of < f.doc_id and f.n_words >= 50
        cover[f.doc_id].update(range(f.start_word, f.end_word))
    seen = {}
    for k, t in enumerate(corpus):
        w = words((t or "").translate(LOW))
        for s in range(len(w) - 49):
            first = seen.setdefault(tuple(w[s : s + 50]), k)
            if first != k:
                assert set(range(s, s + 50)) <= cover[k], (k, s, first)
    clean = [k for k in range(8, 48) if k not in (13, 15)]
    assert not any(f.doc_id in clean for f in found)


def test_repeats_are_cut_and_the_rest_stays(spark, corpus):
    docs = frame(spark, corpus)
    found = substring_dedup.repeated_passages(docs)
    out = {r.doc_id: r for r in substring_dedup.remove_repeats(docs, found).collect()}
    assert len(out) == len(corpus) and set(out[0].asDict()) == set(docs.columns)
    hit = {r.doc_id for r in found.collect()}
    for k, t in enumerate(corpus):
        assert (out[k].text == t) if k not in hit else len(out[k].text) < len(t)
        assert out[k].n_chars == len(out[k].text or "")


def test_vectors_against_brute_force(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 16)).astype(np.float32)
    for k in range(60):
        x[200 + k] = x[k // 20] + r.normal(size=16).astype(np.float32) * 0.05
    x[280] = x[281]
    label = r.integers(0, 2, 300).tolist()
    for k in range(60):
        label[200 + k] = label[k // 20]
    label[281] = label[280]
    rows = [(k, [float(v) for v in x[k]], label[k], "extra") for k in range(300)]
    rows += [(300, None, 1, ""), (301, [0.0] * 16, 1, ""), (302, [float("nan")] * 16, 1, ""), (303, [None] * 16, 1, ""), (304, rows[0][1], None, ""), (305, [], 0, "")]
    got = {g.vec_id: g for g in vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, comp string")).collect()}
    assert len(got) == 306
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (np.array(label)[:, None] == np.array(label)[None])
    np.fill_diagonal(near, False)
    assert sum(got[k].n_links for k in range(300)) >= 0.97 * near.sum() > 0
    assert all(got[k].n_links <= near[k].sum() for k in range(300))
    assert all(got[k].n_links == 0 and got[k].kept for k in range(300, 306))
    assert all(got[k].kept == (got[k].component_id == k) for k in got)


def test_html(spark):
    page = "<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>Head &amp; all</h1><p><b>One  two<br>three<p>Four &lt;five&gt;</article><aside><p>See also this</p></aside><footer>c</footer>"
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.train(pages)
    rows = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (3, "u", "", 5), (4, "u", page, 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_extract.extract(rows, model).collect()}
    assert got[1].text == got[4].text == "Head & all\nOne two three\nFour <five>"
    assert got[2].text == got[3].text == "" and got[1].n_chars == len(got[1].text)


def test_html_without_telling_names(spark):
    """Hand-made pages whose class names say nothing, and the scanner's stray quotes."""
    model = html_extract.train(spark.read.parquet(f"{SF}/pages.parquet"))
    said = ["It was a long day in the city, and the people who lived there had seen nothing like it before.", "Nobody knew what would come next. They waited, and they talked about it all night long.", "In the end the rain came down on all of them alike."]
    top = "<div class='c1'><a href='/'>Home</a> <a href='/a'>About</a></div>"
    body = "<h1>The big story</h1>" + "".join(f"<p>{x}</p>" for x in said)
    want = "\n".join(["The big story", *said])
    for page in (
        f"<html><body>{top}<div class='c7'>{body}</div><div class='bottom'>Copyright 2024</div></body></html>",
        f"<html><body><div class=q><div class=x9>{top}</div><div class=m4>{body}</div><div class=z><ul><li><a href=1>Privacy policy</a></li><li><a href=2>Terms</a></li></ul></div></div></body></html>",
        f"<html><body>{top}<section class=k>{body}</section><form class=u><p>Subscribe</p></form><div class=w>Copyright 2024</div></body></html>",
    ):
        rows = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
        assert html_extract.extract(rows, model).first().text == want
    cut = lambda page: [t for t, _, _ in html_extract.blocks(page)]
    assert cut("<p class=don't>hello</p><p>two</p><p>it's three</p>") == ["hello", "two", "it's three"]
    assert cut('<div class="a>b</div><p title="1>2">c</p><p>d</p') == ["b", "c", "d"]
    assert html_extract.extract(rows.where("false"), model).count() == 0


def landmark(word):
    return bytes(toxicity._LETTER[x] for x in word.encode() if toxicity._LETTER[x])


def test_string_kernel_tolerates_gaps():
    import pyarrow as pa

    marks = toxicity.Landmarks([landmark("idiot"), landmark("дурак")])
    near = lambda w, k: float(marks.sentences(*textvec.buffers(pa.array([w])))[1].max(0, initial=0)[k])
    assert all(near(w, 0) == pytest.approx(1) for w in ("idiot", "i.d.i.o.t", "i d i o t", "ID1OT"))
    assert near("idxiot", 0) > 0.02 and near("moderation", 0) < 0.02
    assert near("Дурак", 1) == pytest.approx(1) and near("ду-рак", 1) == pytest.approx(1) and near("дууурак", 1) > 0.02 and near("работа", 1) < 0.02


def test_bound_of_the_kernel_leaves_out_nothing():
    r = np.random.default_rng(1)
    marks = toxicity.Landmarks([landmark(w) for w in ("idiot", "worthless", "scum", "abcdefghijklmnop")])
    rows = np.zeros((2000, toxicity.LENGTH), np.uint8)
    for k in range(len(rows)):
        n = r.integers(3, 16)
        rows[k, :n] = r.choice(np.frombuffer(landmark("idiotworthlescum"), np.uint8), n)
    got = marks.similar(rows)
    for k in range(4):
        full = toxicity.kernel(rows, np.repeat(marks.rows[k : k + 1], len(rows), 0)) / np.sqrt(toxicity.kernel(rows, rows) * marks.own[k])
        assert np.allclose(got[:, k], np.where(full >= toxicity.LOW, np.exp(toxicity.SHARP * (np.minimum(full, 1) - 1)), 0), atol=1e-3)


def test_the_worst_sentence_counts(spark):
    r = np.random.default_rng(2)
    say = lambda bad: ". ".join([sentence(r, 8) for _ in range(6)] + ([f"you are an {'idiot' if r.random() < 0.5 else 'id-i-ot'} so go"] if bad else ["so you are here"]) + [sentence(r, 8)])
    rows = [(k, say(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.col("doc_id") < 300)
    got = {x.doc_id: x.score for x in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.7) == bool(y) for k, _, y in rows if k >= 300)
    assert toxicity.train(docs, labels.where("toxic = 0"), F.lit(True)) is None
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_toxicity_and_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r for r in labels.collect()}
    held = lambda d, k, m: zlib.crc32(str(d).encode()) % k == m
    model = quality_classifier.train(docs, labels, quality_classifier.crc_of_id() % 5 != 0)
    got = {r.doc_id: r.score for r in quality_classifier.score(docs, model).collect()}
    test = [d for d in truth if held(d, 5, 0)]
    assert np.mean([(got[d] >= 0.3) == truth[d].quality for d in test]) > 0.95
    model = toxicity.train(docs, labels, toxicity.crc_of_id() % 3 != 1)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    test = [d for d in truth if held(d, 3, 1)]
    assert np.mean([(got[d] >= 0.7) == truth[d].toxic for d in test]) > 0.9
    edge = frame(spark, [None, "", "x"])
    assert all(0 <= r.score <= 1 for r in toxicity.score(edge, model).collect())
    assert all(r.score == 0.5 for r in quality_classifier.score(edge, None).collect())


def test_bpe_equals_the_library_and_decodes(spark):
    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [None, "", " ", "  ", "   ", "a  b", "a   b", " \n \n b", "a  b", "it's we'll", "<|endoftext|> x", "é" * 300, "ab" * 700, "x\ty\r\nz \n", "日本語 テキスト", "12 345,6!!! ", "end "]
    coded = bpe.encode(frame(spark, texts))
    got = {r.doc_id: r for r in coded.collect()}
    for k, t in enumerate(texts):
        ids = lib.encode_ordinary(t or "")
        assert got[k].ids == " ".join(map(str, ids)) and got[k].n_tokens == len(ids) and got[k].decoded.decode() == (t or ""), repr(t)
    back = {r.doc_id: r.decoded for r in bpe.decode(coded).collect()}
    assert all(bytes(back[k]).decode() == (t or "") for k, t in enumerate(texts))


def test_packing(spark):
    from tokenizers import Tokenizer

    import public_tokenizers as P

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a <|endoftext|> b"), (-3, "a <|endoftext|> b")], "doc_id long, text string"))
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.pack_documents(docs, 512).collect()
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    for d, parts in by_doc.items():
        if d == -3:
            continue
        ids = np.array([*t.encode(text[d] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r.piece):
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    total = sum(r.length for r in rows)
    assert len(by_seq) <= -(-total // 512) * 1.02 + 1
    assert packing.pack_documents(docs.where("false")).count() == 0


def test_plan_places_every_item():
    r = np.random.default_rng(2)
    counts = {int(k): int(v) for k, v in zip(range(1, 2048), r.integers(0, 30, 2047)) if v}
    room, used = defaultdict(int), defaultdict(int)
    for length, rank, n, first, offset in packing.plan(counts):
        assert rank == used[length]
        used[length] += n
        for s in range(first, first + n):
            assert room[s] == offset
            room[s] += length
    assert used == counts and max(room.values()) <= 2048
    assert len(room) <= sum(k * v for k, v in counts.items()) / 2048 * 1.02 + 1


def test_shards_follow_the_metadata(spark):
    r = np.random.default_rng(4)
    rows = [(k, sentence(r, int(r.integers(20, 60))), f"l{k % 8}", f"s{k % 3}") for k in range(1600)]
    rows += [(2000 + k, "same text", f"l{k % 8}", f"s{k % 5}") for k in range(60)] + [(None, None, None, None), (5, "", "l1", None)] * 2
    docs = spark.createDataFrame([(*x, 1, "x") for x in rows], "doc_id long, text string, lang string, source string, shard int, slot string")
    got = sharding.kd_shards(docs).collect()
    assert len(got) == len(rows)
    size = defaultdict(int)
    for x in got:
        size[x.shard] += x.size
    assert len(size) == 8 and max(size.values()) <= 1.02 * min(size.values())
    of = {x.doc_id: x.shard for x in got}
    assert len({of[2000 + k] for k in range(60)}) == 1
    spread = defaultdict(set)
    for k, _, lang, source in rows[:1600]:
        spread[lang, source].add(of[k])
    print(sum(len(v) for v in spread.values()))
    assert sum(len(v) for v in spread.values()) <= 120  # of 192, which a hash would make of 24 pairs
    for s in range(8):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))


def test_shards(spark, corpus):
    got = sharding.kd_shards(frame(spark, corpus * 8)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
        t = (corpus * 8)[r.doc_id] or ""
        assert r.size == len(t.encode()) + 1 and r.text_crc32 == zlib.crc32(t.encode())
    sizes = [sum(r.size for r in v) for v in by.values()]
    assert len(got) == 8 * len(corpus) and len(by) == 8 and max(sizes) - min(sizes) <= 0.2 * max(sizes)
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.kd_shards(frame(spark, ["a"]).where("false")).count() == 0


def test_quality_counts(spark, corpus):
    texts = [*corpus, "a b\na b\n\n \na b", "#x $$ y|", "w " * 40]
    got = {r.doc_id: r for r in quality_rules.quality_rules(frame(spark, texts)).collect()}
    for k, t in enumerate(texts):
        w = words(t)
        lines = [x for x in (t or "").split("\n") if words(x)]
        at = defaultdict(list)
        for s in range(len(w) - 7):
            at[tuple(w[s : s + 8])].append(s)
        rep = {p for v in at.values() if len(v) > 1 for s in v for p in range(s, s + 8)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(rep))
        g = got[k]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want, k
        assert g.base_failed == (len(w) < 20 or 100 * len(rep) > 30 * len(w)) and not (g.base_failed and g.kept)


def test_kneser_ney_sums_to_one(spark):
    docs = frame(spark, ["the cat sat on the mat", "the dog sat on the log", "a cat on a mat"] * 3).withColumn("lang", F.lit("en"))
    counts = quality_rules.count_ngrams(quality_rules._folds(docs).withColumn("fold", F.lit(0)))
    kinds = quality_rules.kinds_of(np.frombuffer(b"the ", np.uint8), np.array([0, 4]))
    seen = int(quality_rules.ngram_keys(*kinds)[-1]) & 0xFFFFFFFF
    ask = np.array([seen << 8 | c for c in range(256)])
    for rare in (quality_rules.RARE, 40):  # with and without n-grams left to the lower orders
        table = quality_rules.kneser_ney(counts, rare=rare).toArrow()
        model = quality_rules.Model(table)
        look = next(iter(model.by.values()))
        assert look(ask).sum() == pytest.approx(1, abs=1e-4)
    assert table.num_rows < quality_rules.kneser_ney(counts).count()


def test_word_hashes_do_not_depend_on_place():
    import pyarrow as pa

    data, off = textvec.buffers(pa.array(["alpha beta", None, "beta  alpha", ""]))
    s, e, w = textvec.word_bounds(data, off)
    h = textvec.word_hashes(data, s, e)
    assert w.tolist() == [0, 2, 2, 4, 4] and h[0] == h[3] and h[1] == h[2] and h[0] != h[1]
    assert hashlib.md5(h.tobytes()).hexdigest() == hashlib.md5(textvec.word_hashes(data, s, e).tobytes()).hexdigest()


def test_quality_rules_reject_junk_of_every_script(spark):
    """Random letters of a language's own script are rejected by perplexity, its texts are kept."""
    r = np.random.default_rng(12)
    rows, junk = [], set()
    for lang, letters in (("en", "abcdefghijklmnopqrstuvwxyz"), ("ru", "абвгдежзиклмнопрстуфхцчшщыэюя"), ("el", "αβγδεζηθικλμνξοπρστυφχψω"), ("ja", "あいうえおかきくけこさしすせそたちつてとなにぬねの")):
        syllables = ["".join(r.choice(list(letters), 2)) for _ in range(40)]
        for k in range(210):
            bad = k % 30 == 7
            word = (lambda: "".join(r.choice(list(letters), int(r.integers(2, 9))))) if bad else (lambda: "".join(r.choice(syllables, int(r.integers(1, 4)))))
            rows.append((len(rows), " ".join(word() for _ in range(int(r.integers(40, 200)))), lang, "x"))
            junk |= {len(rows) - 1} if bad else set()
    rows += [(9000, None, "en", "x"), (9001, "", None, "x"), (9002, "one word", "xx", "x"), (9003, rows[0][1], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    for most in (quality_rules.MODEL_ROWS, 1):
        got = {x.doc_id: x for x in quality_rules.quality_rules(docs, most=most).collect()}
        assert len(got) == len(rows) and not any(got[k].base_failed for k in range(840))
        assert not any(got[k].kept for k in junk)
        assert sum(got[k].kept for k in range(840) if k not in junk) >= 0.98 * (840 - len(junk))
        assert [got[k].kept for k in (9000, 9001, 9002)] == [False] * 3 and got[9003].log_perplexity == pytest.approx(got[0].log_perplexity)
    assert quality_rules.quality_rules(docs.where("false")).count() == 0
