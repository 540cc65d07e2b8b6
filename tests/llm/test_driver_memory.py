"""Memory that stages leave with the driver."""

import tracemalloc

import numpy as np

from riskline.llm.common import give_back
from riskline.llm.toxicity_gru import hashed_inputs


def test_grams_of_many_words_are_hashed_in_steps():
    words = [b"word%d" % i for i in range(100_000)]
    tracemalloc.start()
    bucket, flat, counts = hashed_inputs(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * (bucket.nbytes + flat.nbytes + counts.nbytes)  # 10 times that at once
    for k in (0, 8191, 8192, 99_999):
        b, f, n = hashed_inputs(words[k:k + 1])
        end = counts[:k + 1].sum()
        assert b[0] == bucket[k] and n[0] == counts[k] and f.tolist() == flat[end - counts[k]:end].tolist()
    assert [len(x) for x in hashed_inputs([])] == [0, 0, 0]


def test_freed_memory_goes_back_to_the_system():
    private = lambda: int(open("/proc/self/smaps_rollup").read().split("Pss_Anon:")[1].split()[0])  # noqa: E731, SIM115
    held = [np.ones(5000) for _ in range(4000)]  # 160 MB in pieces that the allocator keeps
    last, before = held[::500], private()
    del held
    give_back()
    assert before - private() > 100_000 and len(last) == 8
