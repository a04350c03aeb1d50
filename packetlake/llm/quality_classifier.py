"""Quality classifier: ridge regression on random Fourier features of document statistics, then isotonic calibration.

The features' number is fixed, so each partition sends one sum of normal equations; the calibration works on a fixed
number of score bins. Training may use a bounded sample of the labelled rows (SAMPLE rows, chosen by a hash of the id).

Edge cases: null and empty texts get the statistics of an empty text and a score; without labelled rows every score is
0.5; rows are scored one by one, so repeats agree; extra columns are kept by `classify` and ignored by the query.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import crc_of_id, saved, settings, table
from .quality_rules import base_counts

FEATURES, GAMMA, RIDGE, BINS, SAMPLE = 256, 0.5, 1e-3, 512, 200_000
STATS = 15


def _classes() -> np.ndarray:
    """Byte -> class 1..63."""
    c = np.zeros(256, np.int64)
    c[:] = 63  # control
    c[ord("a") : ord("z") + 1] = np.arange(1, 27)
    c[ord("A") : ord("Z") + 1] = np.arange(27, 53)
    c[tv.SPACE] = 54
    c[32], c[48:58] = 53, 55
    for k, chars in ((56, ".,;:!?"), (57, "\"'()-"), (58, "#*$%&|<>"), (59, "/\\_@=+~^`[]{}")):
        c[[ord(x) for x in chars]] = k
    c[128:192], c[192:224], c[224:256] = 60, 61, 62
    return c


CLASS = _classes()


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """STATS numbers of about unit scale for each document."""
    c = base_counts(data, offsets)
    n = np.maximum(np.diff(offsets), 1).astype(float)
    kinds = CLASS[data]

    def share(mask):
        return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets]) / n

    words = np.maximum(c["n_words"], 1)
    starts, ends, woff = tv.word_bounds(data, offsets)
    wh = tv.word_hashes(data, starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(woff))
    order = np.lexsort((wh, doc))
    new = np.ones(len(wh), bool)
    new[1:] = (wh[order][1:] != wh[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    distinct = np.bincount(doc[order][new], minlength=len(n)) if len(wh) else np.zeros(len(n))
    follow = np.zeros(len(wh), bool)
    follow[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    runs = np.bincount(doc[follow], minlength=len(n)) if len(wh) else np.zeros(len(n))
    lines = np.diff(np.concatenate([[0], np.cumsum(data == 10)])[offsets]) + 1
    upper = (kinds >= 27) & (kinds <= 52)
    return np.stack([
        np.log1p(c["n_words"]) / 4, c["word_chars"] / words / 8, 4 * share(upper), 6 * share(kinds == 58), 6 * share(kinds == 55), 6 * share(data == 33),
        4 * share((kinds == 56) | (kinds == 57)), 2 * c["n_dup_lines"] / lines, 2 * c["n_repeat_words"] / words, distinct / words, 3 * runs / words,
        2 * share((kinds == 60) | (kinds == 61) | (kinds == 62)), np.log1p(lines) / 4, 6 * share(kinds == 59), 6 * share(kinds == 53),
    ], axis=1)


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics."""

    def run(batches):
        for b in batches:
            for i, j, data, off in tv.documents(b.column(1)):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), STATS).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, x array<double>")


def fourier(features: int = FEATURES, gamma: float = GAMMA, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.normal(0, np.sqrt(2 * gamma), (STATS, features)), r.uniform(0, 2 * np.pi, features)


def lift(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = np.cos(x @ w + b) * np.sqrt(2 / len(b))
    return np.hstack([z, np.ones((len(x), 1))])


def fit(labelled: DataFrame, label: str = "label", ridge: float = RIDGE):
    """(weights, bin edges, calibrated values) from rows with x and a 0/1 label."""
    w, b = fourier()
    d = len(b) + 1

    def sums(batches):
        total, n = np.zeros((d, d + 1)), 0
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, STATS)
            y = batch.column(1).to_numpy().astype(float)
            z = lift(x, w, b)
            total[:, :d] += z.T @ z
            total[:, d] += z.T @ y
            n += len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], names=["s", "n"])

    rows = labelled.select("x", F.col(label).cast("double").alias("y")).coalesce(16)  # 16 sums of a fixed size come to the driver
    got = rows.mapInArrow(sums, "s binary, n long").collect()
    if not got:
        return None
    total = sum(np.frombuffer(r["s"]).reshape(d, d + 1) for r in got)
    n = sum(r["n"] for r in got)
    theta = np.linalg.solve(total[:, :d] + ridge * n * np.eye(d), total[:, d])

    def bins(batches):
        for batch in batches:
            x = np.array(batch.column(0).flatten()).reshape(-1, STATS)
            raw = lift(x, w, b) @ theta
            k = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(k), batch.column(1)], names=["bin", "y"])

    by = {r["bin"]: (r["n"], r["s"]) for r in rows.mapInArrow(bins, "bin long, y double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect()}
    return theta, isotonic(by)


def isotonic(by: dict[int, tuple[int, float]]) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over the bins; (bin centres of the pools, values)."""
    pools: list[list[float]] = []  # weight, sum, first bin, last bin
    for k in sorted(by):
        pools.append([by[k][0], by[k][1], k, k])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            n, s, _, last = pools.pop()
            pools[-1][0] += n
            pools[-1][1] += s
            pools[-1][3] = last
    xs, ys = [], []
    for n, s, first, last in pools:
        v = (s + 0.5) / (n + 1)
        xs += [first, last] if last > first else [first]
        ys += [v, v] if last > first else [v]
    return np.array(xs, float), np.maximum.accumulate(np.array(ys, float))


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id, score."""
    w, b = fourier()

    def run(batches):
        for batch in batches:
            for i, j, data, off in tv.documents(batch.column(1)):
                if model is None:
                    s = np.full(j - i, 0.5)
                else:
                    theta, (xs, ys) = model
                    raw = (lift(statistics(data, off), w, b) @ theta + 0.5) / 2 * BINS
                    s = np.clip(np.interp(raw, xs, ys), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array(s)], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, where, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, label of at most about `sample` labelled rows; which ones, a hash of the id decides. So bounded, they are broadcast."""
    own = labels.where(F.col(label).isNotNull() & where).groupBy("doc_id").agg(F.max(label).alias("label"))
    n = own.count()
    if n > sample:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < 1_000_000 * sample // n)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id")


def train(docs: DataFrame, labels: DataFrame, where) -> tuple:
    rows = labelled_rows(docs, labels, "quality", where).select("doc_id", "text", "label")

    def run(batches):
        for b in batches:
            for i, j, data, off in tv.documents(b.column(0)):
                x = statistics(data, off)
                yield pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(x.ravel(), pa.float64()), STATS).cast(pa.list_(pa.float64())), b.column(1)[i:j]], names=["x", "label"])

    return fit(saved(rows.select("text", F.col("label").cast("int")).mapInArrow(run, "x array<double>, label int")))


def op8_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_of_id() % 5 != 0)
    return score(docs, model).select("doc_id", (crc_of_id() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def scorer(model):
    """A function from a batch's bytes and offsets to scores, for filter_by."""
    w, b = fourier()

    def run(data, offsets):
        if model is None:
            return np.full(len(offsets) - 1, 0.5)
        theta, (xs, ys) = model
        return np.clip(np.interp((lift(statistics(data, offsets), w, b) @ theta + 0.5) / 2 * BINS, xs, ys), 0, 1)

    return run


def filter_by(docs: DataFrame, scores, keep) -> DataFrame:
    """The rows of docs, all columns, whose text's score passes `keep`; one pass, no shuffle."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for i, j, data, off in tv.documents(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(keep(scores(data, off))))

    settings(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)
