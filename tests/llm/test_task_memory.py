"""What a task holds at once while it cuts text into words and phrases: a few times the text, not tens of times."""

import tracemalloc
from unittest import mock

import numpy as np
import pyarrow as pa
import pytest

from packetlake.llm import collocations, lattice_lm


def texts(n: int, words: int) -> pa.Array:
    r = np.random.default_rng(5)
    kinds = np.array([f"word{k}" for k in range(200_000)])
    return pa.array([" ".join(kinds[r.integers(0, len(kinds), words)]) for _ in range(n)])


def peak_mb(module, make, batches) -> tuple[float, int]:
    """Most that numpy held in the step that `make` gives to mapInArrow, and the words that came out."""
    docs = mock.MagicMock()
    docs.select.return_value = docs
    with mock.patch.object(module, "F", mock.MagicMock()):
        make(docs)
    run = docs.mapInArrow.call_args[0][0]
    tracemalloc.start()
    try:
        rows = sum(len(b) for b in run(iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_a_chunk_of_the_lattice_is_cut_in_pieces():
    text = texts(5500, 250)  # 14 MB
    rows = pa.table({"id": np.arange(len(text)), "held": np.arange(len(text)) % 10 == 0, "text": text})
    task = mock.MagicMock()
    task.get.return_value.partitionId.return_value = 0
    with mock.patch.object(lattice_lm, "TaskContext", task), mock.patch.object(lattice_lm, "crc_of_id", mock.MagicMock()):
        mb, n = peak_mb(lattice_lm, lattice_lm.chunks, rows.to_batches(1000))
    assert n > 200_000 + 5500 - 1000 and mb < 60, mb


@pytest.mark.parametrize("orders", [(1,), (2,), (3, 4)])
def test_phrases_are_counted_in_small_pieces(orders):
    text = texts(3000, 250)
    known = mock.MagicMock(value=np.full(collocations.BITS // 32, 0xFFFFFFFF, np.uint32))
    rows = pa.table({"lang": ["en"] * len(text), "text": text})
    mb, n = peak_mb(collocations, lambda docs: collocations.ngrams(docs, orders, known), rows.to_batches(1000))
    assert n > 100_000 and mb < 90, mb
