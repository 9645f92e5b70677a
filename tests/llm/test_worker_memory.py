"""Finding on the pipeline: workers that wait hold little memory."""

import numpy as np
from fotolake.llm import ngram_join, shingles
from fotolake.llm.common import frugal


def held_mb() -> float:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 / 1e6


def test_task_hands_freed_memory_back():
    def task(batches):
        # Pieces that the heap keeps, as something after each of them stays.
        pieces = [np.ones(2_000) for _ in range(20_000)]
        kept.extend(np.ones(2_000) for _ in range(1))
        yield from batches
        assert len(pieces)

    kept: list = []
    list(task(iter([])))
    before = held_mb()
    list(frugal(task)(iter([])))
    assert held_mb() < before + 30


def test_bounds_of_a_task():
    """A worker of the n-gram join formerly held three million signatures and a million words."""
    assert ngram_join.HELD <= 1_000_000 and shingles.CACHE_ITEMS <= 250_000
