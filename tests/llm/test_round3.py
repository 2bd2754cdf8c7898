"""One rule for the tree's stored continuations; SimHash in the near-copy stage."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import near_copies, suffix_tree


def test_stored_continuations_follow_the_share_alone(spark):
    """No least count beside the share; continuations seen once are free of effect, as they count one less than seen."""
    rng = random.Random(3)
    docs = spark.createDataFrame(
        [(i, " ".join(rng.choice("abcdefgh") + rng.choice(["", "", "x" + str(i)]) for _ in range(20))) for i in range(60)], "doc_id long, text string")
    tree, vocabulary, total, _ = suffix_tree.learn(docs)
    shared = spark.sparkContext.broadcast(suffix_tree.Tree(tree.words, tree.base, []))
    texts = docs.select("doc_id", "text")
    once = suffix_tree.grow(texts, shared, 1, total, suffix_tree.LEAST, suffix_tree.DIVERGENCE)
    twice = suffix_tree.grow(texts, shared, 1, total, 2 / total, suffix_tree.DIVERGENCE)
    assert len(once[4]) > len(twice[4]) and len(once[0]) and np.array_equal(once[0], twice[0])
    a, b = ({r.doc_id: r.score for r in suffix_tree.score(docs, least=x).collect()} for x in (suffix_tree.LEAST, 2 / total))
    assert a.keys() == b.keys() and all(abs(a[d] - b[d]) < 1e-9 for d in a)


def test_near_copy_stage_links_by_simhash(spark, monkeypatch):
    """Close copies are linked by their fingerprints alone, and what is found is measured."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(3000)]
    near = [*base[:1500], "other", *base[1501:]]
    docs = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(f"v{rng.randrange(900)}" for _ in range(400)))]
    docs += [(4, "a b c d e f"), (5, "a b c d e f a b c d e f a b c d e f"), (6, "A b c d e f")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    whole = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    monkeypatch.setattr(near_copies, "bands", lambda x: [near_copies.set_id(x)])  # no two sets share a band
    assert whole == sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 3, 4, 5]
