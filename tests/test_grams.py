"""Two passes over blocks of texts against plain counts of n-grams."""

import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from tesserae.operators import analytics as an


@pytest.mark.parametrize(("n", "stop"), [(1, None), (2, None), (2, ["w1", "w2"]), (3, None)])
def test_only_grams_of_full_buckets_are_counted_in_the_end(monkeypatch, n, stop):
    monkeypatch.setattr(an, "BLOCK", 700)
    rng, k = random.Random(n), 5
    texts = [[f"w{int(rng.paretovariate(0.8)) % 300}" for _ in range(rng.randint(0, 60))] for _ in range(150)]
    times, docs = Counter(), Counter()
    for words in texts:
        left = [w for w in words if w not in (stop or [])]
        mine = [" ".join(left[i : i + n]) for i in range(len(left) - n + 1)]
        times.update(mine)
        docs.update(set(mine))
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[i : i + 20], pa.list_(pa.string()))], names=["words"]) for i in range(0, 150, 20)]
    filled, low = Counter(), Counter()
    for out in an._grams(n, stop, k, None)(iter(batches)):
        for r in out.to_pylist():
            (low if r["gram"] else filled)[r["gram"] or r["bucket"]] += r["n"]
    assert sum(filled.values()) == sum(times.values()) and all(low[g] <= times[g] for g in low)
    least = sorted(low.values())[-k]
    full = np.zeros(an.BUCKETS, bool)
    full[[b for b, x in filled.items() if x >= least]] = True
    got_n, got_docs = Counter(), Counter()
    for out in an._grams(n, stop, k, SimpleNamespace(value=full))(iter(batches)):
        for r in out.to_pylist():
            got_n[r["gram"]] += r["n"]
            got_docs[r["gram"]] += r["docs"]
    assert all(got_n[g] == times[g] and got_docs[g] == docs[g] for g in got_n)
    assert {g for g in times if times[g] >= least} <= set(got_n) and len(got_n) < len(times) / 3
