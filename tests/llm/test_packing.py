"""The configuration LP covers full histograms."""

import numpy as np

from loomgraph.llm import packing


def test_configurations_cover_every_length(monkeypatch):
    rng = np.random.default_rng(4)
    counts = {n: int(k) for n, k in zip(range(1, 1025), rng.integers(200, 2000, 1024))}
    rest, fill = [], packing._fill
    monkeypatch.setattr(packing, "_fill", lambda c, capacity: rest.append(sum(c.values())) or fill(c, capacity))
    plan, placed = packing.configure(counts), {}
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern.items()) <= 1024
        for n, k in pattern.items():
            placed[n] = placed.get(n, 0) + k * times
    assert placed == counts
    # Best fit sees the rounding remainder alone.
    assert len(rest) == 1 and rest[0] < 0.02 * sum(counts.values())
    assert sum(t for _, t in plan) <= 1.005 * sum(t for _, t in fill(counts, 1024))
