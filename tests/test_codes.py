from __future__ import annotations

import numpy as np
import pytest

from polycloud import codes
from polycloud.functions import quantize as Q


@pytest.mark.parametrize("name", [n for n in Q.NAMES if n != "none"])
def test_sides_made_once_meet_as_codes_do(name):
    g = np.random.default_rng(3)
    x = g.normal(size=(300, 64))
    z = Q.make(name).fit(x)
    a, b, want = z.query_side(x[:20]), z.item_side(x), z.dots(x[:20], z.encode(x))
    got = z.look_up(a, b)[0] if z.tables else a @ b.T
    assert np.abs(got - want).max() < 1e-9


def test_codes_of_pairs_are_made_in_steps(spark, sf_dir, monkeypatch):
    """The same rows from steps of a few pairs as from whole batches: what a task holds does not grow with its batch."""
    whole = {n: sorted(codes.quantized(spark, sf_dir, n).collect()) for n in ("rabitq", "pq", "tq1")}
    monkeypatch.setattr(codes, "STEP", 37)
    assert {n: sorted(codes.quantized(spark, sf_dir, n).collect()) for n in whole} == whole
    assert all(len(rows) == 499 for rows in whole.values())
