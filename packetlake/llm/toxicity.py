"""Toxicity: a support vector machine on a gap-weighted subsequence string kernel with Nystroem landmarks.

Units are sentences. The kernel of a sentence and a landmark is that of its best word: the sum over their common
subsequences of three letters, weighted down by the gaps, so that inserted or missing characters lower it only a little.
Letters of all scripts count (those beyond ASCII by the bytes that tell them apart); case, signs between letters,
look-alike digits and letters written one by one do not hide a word. A kernel below LOW (of 1 for equal words) counts as
none. It is worked out only where it can reach LOW: of two words whose common letters are M, it is at most the root of the
share of the landmark's own kernel that subsequences of letters of M make up, which is tabled for each set M.

Landmarks are the words of labelled toxic texts that stand there far more often than in clean ones (counted by Spark): all
of them, LANDMARKS at most. The Nystroem map of a sentence's kernels feeds a linear machine with squared hinge loss,
trained on labelled sentences: those of clean texts are all negative, and of a toxic text the sentence that the machine of
the round before finds worst is positive. Newton steps work on sums over partitions. A text's decision is that of its worst
sentence, and a logistic link makes the score.

Edge cases: null and empty texts have no word and get the score of a text far from every landmark; words of any length are
read whole, in overlapping windows; without labelled rows of both kinds every score is 0.5; repeated rows agree; an empty
table gives an empty result; extra columns are kept by `filter_by`.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import crc_of_id, saved, table
from .quality_classifier import SAMPLE, labelled_rows

LANDMARKS, DECAY, SHARP, LENGTH, STRIDE = 24, 0.6, 8.0, 24, 8
#: A normalised kernel below this counts as none; landmarks of more different letters than this have no table of bounds.
LOW, TABLED = 0.4, 10
RIDGE, ROUNDS, STEPS, BINS = 1e-3, 3, 6, 400
#: Letters: 1 to 26 for a to z, then one for each second or later byte of a character beyond ASCII.
KINDS = 91

_LETTER = np.zeros(256, np.uint8)
_LETTER[0x80:0xC0] = 27 + np.arange(64)
for _c in range(26):
    _LETTER[97 + _c] = _LETTER[65 + _c] = 1 + _c
for _c, _as in zip("013457@$", "oieastas"):
    _LETTER[ord(_c)] = 1 + ord(_as) - 97


def _lowered(data: np.ndarray, offsets: np.ndarray):
    """The texts in lower case, where any of them has letters beyond ASCII (the others need none)."""
    if not (data >= 0xC3).any():
        return data, offsets
    text = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return tv.buffers(pc.utf8_lower(text))


def letter_words(data: np.ndarray, offsets: np.ndarray):
    """(letters, word offsets into them, document and sentence of each word); single letters in a row are one word.

    A sentence ends at a word that ends in a full stop, an exclamation or question mark, and at a line's end.
    """
    data, offsets = _lowered(data, offsets)
    starts, ends, woff = tv.word_bounds(data, offsets)
    code = _LETTER[data]
    dash = np.flatnonzero((data[:-2] == 0xE2) & ((data[1:-1] == 0x80) | (data[1:-1] == 0x81))) if len(data) > 2 else np.zeros(0, np.int64)
    code[dash + 1] = code[dash + 2] = 0  # dashes, quotes and the like
    total = np.concatenate([[0], np.cumsum(code > 0)])
    n = total[ends] - total[starts]
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(woff))
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    begins = np.ones(len(n), bool)
    begins[1:] = np.isin(data[ends[:-1] - 1], list(b".!?")) | (lines[starts[1:]] > lines[ends[:-1]]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(begins) - 1
    single = n == 1
    joined = np.zeros(len(n), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    first = np.flatnonzero(~joined)
    at = np.concatenate([total[starts[first]], [total[-1]]]) if len(first) else np.zeros(1, np.int64)
    return code[code > 0], at, doc[first], sentence[first]


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """(letters, starts, ends of the different words of 3 letters or more; document, sentence and word number of each occurrence)."""
    letters, at, doc, sentence = letter_words(data, offsets)
    long = np.flatnonzero(np.diff(at) >= 3)
    s, e = at[:-1][long], at[1:][long]
    h = tv.word_hashes(letters, s, e)
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return letters, s[first], e[first], doc[long], sentence[long], inverse


def padded(letters, s, e):
    """Rows of LENGTH letters (0: none) for each word, longer ones in overlapping windows; and the word of each row."""
    n = e - s
    rows = 1 + np.maximum(0, -(-(n - LENGTH) // STRIDE))
    word = np.repeat(np.arange(len(n)), rows)
    k = np.arange(len(word)) - np.repeat(np.cumsum(rows) - rows, rows)
    start = s[word] + k * STRIDE
    idx = start[:, None] + np.arange(LENGTH)
    ok = idx < e[word][:, None]
    return np.where(ok, letters[np.minimum(idx, max(0, len(letters) - 1))], 0) if len(letters) else np.zeros((len(word), LENGTH), np.uint8), word


def kernel(s: np.ndarray, t: np.ndarray, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted kernel of subsequences of 3 letters, row by row; 0 pads."""
    n, p = len(s), 3
    s, t = s[:, : int((s > 0).sum(1).max(initial=1))], t[:, : int((t > 0).sum(1).max(initial=1))]
    two = decay * decay
    before = np.ones((s.shape[1] + 1, t.shape[1] + 1, n), np.float32)
    for level in range(1, p):
        now = np.zeros_like(before)
        for i in range(1, s.shape[1] + 1):
            run = np.zeros(n, np.float32)
            for j in range(1, t.shape[1] + 1):
                same = (s[:, i - 1] == t[:, j - 1]) & (s[:, i - 1] > 0)
                run = decay * run + two * same * before[i - 1, j - 1]
                now[i, j] = decay * now[i - 1, j] + run
        before = now
    out = np.zeros(n, np.float32)
    for i in range(1, s.shape[1] + 1):
        for j in range(1, t.shape[1] + 1):
            out += two * ((s[:, i - 1] == t[:, j - 1]) & (s[:, i - 1] > 0)) * before[i - 1, j - 1]
    return out


class Landmarks:
    """Landmark words, each as bytes of its letters' numbers."""

    def __init__(self, words: list[bytes]):
        self.words = words
        self.rows = np.array([list(w[:LENGTH]) + [0] * (LENGTH - len(w[:LENGTH])) for w in words], np.uint8).reshape(-1, LENGTH)
        self.own = kernel(self.rows, self.rows)
        self.tables = [self._bounds(k) for k in range(len(words))]

    def _bounds(self, k: int):
        """(letters, for each set of them the share of the landmark's own kernel that they make up); no letters: no bound."""
        kinds = np.unique(self.rows[k][self.rows[k] > 0])
        if len(kinds) > TABLED:
            return np.zeros(0, np.uint8), np.ones(1)
        sets = np.arange(1 << len(kinds))
        kept = np.zeros((len(sets), 256), bool)
        for bit, kind in enumerate(kinds):
            kept[:, kind] = sets >> bit & 1
        row = np.broadcast_to(self.rows[k], (len(sets), LENGTH))
        # a letter outside the set meets nothing, but keeps its place
        left, right = (np.where(kept[sets[:, None], row] | (row == 0), row, other) for other in (254, 255))
        return kinds, kernel(left, right) / self.own[k]

    def similar(self, rows: np.ndarray) -> np.ndarray:
        """exp(SHARP * (normalised kernel - 1)) of each row with each landmark; 0 below LOW."""
        out = np.zeros((len(rows), len(self.words)), np.float32)
        step = 20_000
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            has = np.zeros((len(part), KINDS), bool)
            has[np.arange(len(part))[:, None], part] = True
            pairs = []
            for k, (kinds, share) in enumerate(self.tables):
                mask = np.zeros(len(part), np.int64)
                for bit, kind in enumerate(kinds):
                    mask |= has[:, kind].astype(np.int64) << bit
                near = np.flatnonzero(share[mask] >= LOW * LOW * 0.999)
                pairs.append((near, np.full(len(near), k)))
            w, k = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
            if not len(w):
                continue
            length = (part > 0).sum(1)
            order = np.argsort(length[w], kind="stable")  # rows of like length together, so that little of a table is padding
            w, k = w[order], k[order]
            value = np.concatenate([kernel(part[w[q : q + 4000]], self.rows[k[q : q + 4000]]) for q in range(0, len(w), 4000)])
            # a word's own kernel is at least its unbroken triples, which bounds the normalised value from above
            ok = value >= LOW * 0.999 * np.sqrt((length[w] - 2) * DECAY**6 * self.own[k])
            w, k, value = w[ok], k[ok], value[ok]
            if not len(w):
                continue
            used, inverse = np.unique(w, return_inverse=True)
            by = np.argsort(length[used], kind="stable")
            own = np.empty(len(used), np.float32)
            for q in range(0, len(by), 2000):
                r = part[used[by[q : q + 2000]]]
                own[by[q : q + 2000]] = kernel(r, r)
            norm = value / np.sqrt(np.maximum(own[inverse] * self.own[k], 1e-12))
            out[at + w, k] = np.where(norm >= LOW, np.exp(SHARP * (np.minimum(norm, 1) - 1)), 0)
        return out

    def sentences(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Document and values (best value of any word with each landmark) of the sentences that are like a landmark at all."""
        letters, s, e, doc, sentence, inverse = distinct_words(data, offsets)
        none = np.zeros(0, np.int64), np.zeros((0, len(self.words)), np.float32)
        if not len(s):
            return none
        rows, word = padded(letters, s, e)
        each = self.similar(rows)
        hot = np.flatnonzero(each.any(1))
        if not len(hot):
            return none
        best = np.zeros((len(s), len(self.words)), np.float32)
        np.maximum.at(best, word[hot], each[hot])
        mine = np.flatnonzero(best.any(1)[inverse])
        first = np.flatnonzero(np.concatenate([[True], sentence[mine][1:] != sentence[mine][:-1]]))
        return doc[mine][first], np.maximum.reduceat(best[inverse[mine]], first)


def landmark_words(rows: DataFrame, most: int = LANDMARKS) -> list[bytes]:
    """Words of labelled texts (as bytes of their letters' numbers) by how much more toxic texts hold them than clean ones do; each document counts a word once."""

    def count(batches):
        for b in batches:
            label = b.column(1).to_numpy()
            for i, j, data, off in tv.documents(b.column(0)):
                letters, s, e, doc, _, inverse = distinct_words(data, off)
                pair = np.unique(doc.astype(np.int64) * max(1, len(s)) + inverse)
                d, w = np.divmod(pair, max(1, len(s)))
                toxic = np.bincount(w, weights=label[i:j][d], minlength=len(s)).astype(np.int64)
                clean = np.bincount(w, minlength=len(s)) - toxic
                raw = letters.astype(np.uint8).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([raw[x:y] for x, y in zip(s, e)], pa.binary()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())], names=["word", "toxic", "clean"])

    n = rows.agg(F.sum("label"), F.count("*")).first()
    n1, n0 = n[0] or 0, n[1] - (n[0] or 0)
    if not n1 or not n0:
        return []
    words = rows.select("text", "label").mapInArrow(count, "word binary, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    ratio = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("clean") + 0.5) / (n0 + 1))
    chance = (F.col("toxic") + F.col("clean")) * (n1 / (n1 + n0))  # in toxic texts, if the word were like any other
    often = F.col("toxic") - chance >= 4 * F.sqrt(chance) + 3
    best = words.where((F.col("toxic") >= max(3, 0.004 * n1)) & often & (F.length("word") <= LENGTH)).withColumn("lift", ratio).where("lift > 2.0").orderBy((F.col("toxic") * F.col("lift")).desc(), "word").limit(most)
    return [bytes(r["word"]) for r in best.collect()]


def _map(marks: Landmarks) -> np.ndarray:
    """K ** -1/2 of the landmarks' own kernel."""
    k = np.maximum(marks.similar(marks.rows), marks.similar(marks.rows).T).astype(float)
    np.fill_diagonal(k, 1)
    value, vector = np.linalg.eigh(k)
    return vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T


def train(docs: DataFrame, labels: DataFrame, where, sample: int = SAMPLE):
    """(words, Nystroem map, weights, slope, shift), or None."""
    rows = saved(labelled_rows(docs, labels, "toxic", where, sample).select("text", F.col("label").cast("int")))
    words = landmark_words(rows)
    if not words:
        return None
    nystroem = _map(Landmarks(words))

    m = len(words)

    def features(batches):
        marks = Landmarks(words)
        for b in batches:
            for i, j, data, off in tv.documents(b.column(0)):
                doc, value = marks.sentences(data, off)
                z = (value @ nystroem).astype(float)
                bounds = np.searchsorted(doc, np.arange(j - i + 1)) * m
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(z.ravel())), b.column(1)[i:j]], names=["z", "label"])

    table_ = saved(rows.mapInArrow(features, "z array<double>, label int")).coalesce(16)
    d = m + 1
    n = table_.agg(F.sum("label"), F.count("*")).first()
    heavy = 0.5 * n[1] / n[0], 0.5 * n[1] / (n[1] - n[0])  # both kinds count the same

    def sentences(b):
        """Features (the last one is 1) of all sentences, and where each document's begin; the first stands for those like no landmark."""
        size = b.column(0).value_lengths().to_numpy() // m + 1
        begins = np.cumsum(size) - size
        z = np.zeros((size.sum(), d))
        z[:, m] = 1
        rest = np.ones(len(z), bool)
        rest[begins] = False
        z[rest, :m] = b.column(0).flatten().to_numpy().reshape(-1, m)
        return z, begins, size

    def sums(theta, before):
        def run(batches):
            h, g = np.zeros((d, d)), np.zeros(d)
            for b in batches:
                z, begins, size = sentences(b)
                y = np.repeat(2.0 * b.column(1).to_numpy() - 1, size)
                worst = np.maximum.reduceat(z @ before, begins)
                chosen = z @ before >= np.repeat(worst, size)
                c = np.where(y > 0, heavy[0] * chosen / np.repeat(np.maximum(np.add.reduceat(chosen, begins), 1), size), heavy[1] / np.repeat(size, size))
                margin = 1 - y * (z @ theta)
                a = margin > 0
                h += (z[a] * c[a, None]).T @ z[a]
                g -= (z[a] * (c * y * margin)[a, None]).sum(0)
            yield pa.RecordBatch.from_arrays([pa.array([np.append(h.ravel(), g).tobytes()], pa.binary())], names=["s"])

        got = sum(np.frombuffer(r["s"]) for r in table_.mapInArrow(run, "s binary").collect())  # at most 16 sums of a fixed size
        return got[: d * d].reshape(d, d) / n[1], got[d * d :] / n[1]

    before = np.append(nystroem.sum(0), 0.0)  # at first, the sentence nearest to the landmarks as a whole
    for _ in range(ROUNDS):
        theta = np.zeros(d)
        for _ in range(STEPS):
            h, g = sums(theta, before)
            move = np.linalg.solve(h + RIDGE * np.eye(d), g + RIDGE * theta)
            theta = theta - move
            if np.abs(move).max() < 1e-6:
                break
        if np.abs(theta - before).max() < 1e-3:
            break
        before = theta

    def decided(batches):
        for b in batches:
            z, begins, _ = sentences(b)
            value = np.maximum.reduceat(z @ theta, begins)
            bin_ = np.clip((value + 2) / 4 * BINS, 0, BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), b.column(1)], names=["bin", "label"])

    bins = table_.mapInArrow(decided, "bin long, label int").groupBy("bin").agg(F.sum("label").alias("y"), F.count("*").alias("n")).collect()
    x, y, c = (np.array(v, float) for v in zip(*((r["bin"] * 4 / BINS - 2, r["y"], r["n"]) for r in bins)))
    slope, shift = _logistic(x, y, c)
    return words, nystroem, theta, slope, shift


def _logistic(x, y, c, ridge: float = 1e-2):
    """Platt's link on binned decisions, by Newton steps."""
    a = np.zeros(2)
    z = np.stack([x, np.ones_like(x)], 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = (z * (c * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2)
        move = np.linalg.solve(h, z.T @ (c * p - y) + ridge * a)
        a = a - np.clip(move, -5, 5)
    return a


def scorer(model):
    """A function from a batch's bytes and offsets to scores."""
    if model is None:
        return lambda data, offsets: np.full(len(offsets) - 1, 0.5)
    words, nystroem, theta, slope, shift = model
    marks: list = []

    def run(data, offsets):
        if not marks:
            marks.append(Landmarks(words))
        doc, value = marks[0].sentences(data, offsets)
        decision = np.full(len(offsets) - 1, theta[-1])
        np.maximum.at(decision, doc, value @ nystroem @ theta[:-1] + theta[-1])
        return 1 / (1 + np.exp(-np.clip(slope * decision + shift, -30, 30)))

    return run


def score(docs: DataFrame, model) -> DataFrame:
    scores = scorer(model)

    def run(batches):
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1), 1 << 20):
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array(scores(data, off).astype(float))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_of_id() % 3 != 1)
    return score(docs, model).select("doc_id", (crc_of_id() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
