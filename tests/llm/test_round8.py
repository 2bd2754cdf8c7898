"""The suffix tree holds all words and repeated continuations, whatever pieces and buckets the corpus is cut into."""

import math
import random
import zlib

import numpy as np
import pytest
from test_models import plain_tree, tokens

from lexiloom.llm import suffix_rounds, suffix_tree


@pytest.mark.parametrize("piece_bytes, bucket_tokens", [(1 << 20, 1 << 20), (700, 90)])
def test_no_word_or_continuation_is_left_out(spark, monkeypatch, piece_bytes, bucket_tokens):
    """Words beyond the most frequent ones are contexts and continuations too."""
    monkeypatch.setattr(suffix_tree, "SYMBOLS", 8)
    monkeypatch.setattr(suffix_rounds, "PIECE_BYTES", piece_bytes)
    monkeypatch.setattr(suffix_rounds, "BUCKET_TOKENS", bucket_tokens)
    rng = random.Random(8)
    docs = []
    for i in range(150):
        text = [f"w{min(rng.randrange(400), rng.randrange(400))}" for _ in range(rng.randint(0, 20))]
        docs.append((i, " ".join([*text, "rare pair", f"x{i // 2} y{i // 2} z{i // 2}"][:: rng.choice([1, 1, -1])])))
    docs += [(500, None), (501, "never seen words never seen"), (None, "w1 W2"), (7, "w1 w1"), (7, "w1 w1")]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    chance, base, n, unigrams = plain_tree([t for d, t in docs if not held(d)])
    want = []
    for d, t in docs:
        seq = ["<start>", "<start>", *tokens(t)]
        body = seq[2:]
        want.append((-1 if d is None else d, held(d), len(body), sum(unigrams[w] > 0 for w in body), n,
                     round(sum(math.log10(base(w)) for w in body), 8),
                     round(sum(math.log10(chance((seq[i], seq[i + 1]), seq[i + 2])) for i in range(len(body))), 8)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = [(-1 if r[0] is None else r[0], *r[1:5], round(r[5], 8), round(r[6], 8)) for r in suffix_tree.score(df).collect()]
    assert sorted(got) == sorted(want)


def test_pairs_of_a_bucket_are_judged_together():
    """A continuation that two pieces have once each is one that was seen twice."""
    asked = np.array([5, 5, 5, 9]), np.array([2, 3, 2, 2]), np.array([1, 1, 1, 1]), np.array([0.1, 0.2, 0.1, 0.1])
    rest, n, c = suffix_rounds.judged(*asked, divergence=0.02)
    assert np.allclose(rest, [2 / 3, 2 / 3, 2 / 3, 1]) and n.tolist() == [3, 3, 3, 1] and c.tolist() == [2, 1, 2, 1]
