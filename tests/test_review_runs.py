"""Long chains of keys that change hands are settled in runs."""

import random

import pytest
from test_workflow import one_by_one

from lexiloom.operators import reviews


@pytest.mark.parametrize("run", [7, 50, 100_000])
def test_long_chains_like_one_by_one(spark, run, monkeypatch):
    """Few rows and keys, many decisions: the number of checkpoints does not follow the chain."""
    rng = random.Random(run)
    rows, keys, n = 12, 20, 150
    stored = {i: (f"k{i}" if i < 8 else None) for i in range(rows)}
    revs = {f"v{i}": (rng.randrange(rows), f"k{rng.randrange(keys)}", "pending", rng.random() < 0.05) for i in range(n)}
    asked = [(p, f"v{p % n}", rng.choice(["accept"] * 6 + ["reject"])) for p in range(2 * n)]
    given = [(p, v, revs[v][0], revs[v][1], "rejected" if a == "reject" else "payload_invalid" if revs[v][3] else None) for p, v, a in asked]
    cuts, plain_cut = [], reviews.cut_lineage
    monkeypatch.setattr(reviews, "cut_lineage", lambda df: cuts.append(1) or plain_cut(df))
    monkeypatch.setattr(reviews, "RUN", run)
    got = reviews._settle_decisions(
        spark.createDataFrame(rng.sample(given, len(given)), "position long, review_key string, row long, key string, fails string"),
        spark.createDataFrame([(k, i) for i, k in stored.items() if k], "key string, row long")).collect()
    want, _ = one_by_one(stored, revs, asked)
    assert len(got) == len(want) and {r.position: r.outcome for r in got} == want
    assert set(want.values()) == {"accepted", "rejected", "duplicate_identity", "already_decided", "payload_invalid"}
    if run > 2 * n:
        assert len(cuts) <= 10
