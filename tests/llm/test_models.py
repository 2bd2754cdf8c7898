"""Language model scores, the co-trained classifier and the pipeline on small inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lexiloom.llm import cotrain, suffix_tree

END = None


def tokens(text):
    lower = (text or "").translate({i: i + 32 for i in range(65, 91)})
    return [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w] + [END]


def plain_tree(docs, least=0.0, divergence=suffix_tree.DIVERGENCE):
    """The tree's chances by counting: (chance of a token after two others, base chance)."""
    unigrams, contexts = Counter(), {1: {}, 2: {}}
    for text in docs:
        seq = ["<start>", "<start>", *tokens(text)]
        for i in range(2, len(seq)):
            unigrams[seq[i]] += 1
            contexts[1].setdefault((seq[i - 1],), Counter())[seq[i]] += 1
            contexts[2].setdefault((seq[i - 2], seq[i - 1]), Counter())[seq[i]] += 1
    n, v = sum(unigrams.values()), len(unigrams)
    base = lambda w: (unigrams[w] + 1) / (n + v + 1)
    kept = {1: {}, 2: {}}

    def chance(context, w):
        if not context:
            return base(w)
        p = chance(context[1:], w)
        if context in kept[len(context)]:
            extra, rest = kept[len(context)][context]
            return extra.get(w, 0) + rest * p
        return p

    often = set()
    for level in (1, 2):
        for context, counts in contexts[level].items():
            if level == 2 and context not in often:
                continue
            total = sum(counts.values())
            extra = {w: (c - 1) / total for w, c in counts.items() if c >= 2}
            if level == 1:
                often |= {(*context, w) for w in extra}
            rest = 1 - sum(extra.values())
            own = {w: e + rest * chance(context[1:], w) for w, e in extra.items()}
            gain = sum(p * math.log(p / chance(context[1:], w)) for w, p in own.items())
            gain += max(0, 1 - sum(own.values())) * math.log(max(rest, 1e-300))
            if extra and gain >= divergence:
                kept[level][context] = extra, rest
    return chance, base, n, unigrams


def corpus():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    docs = []
    for i in range(160):
        text = [rng.choice(words) for _ in range(rng.randint(0, 12))]
        if i % 3 == 0:
            text += "the old Mill stands by THE river".split()
        docs.append((i, " ".join(text) + ("\tend\n" if i % 5 == 0 else "")))
    return docs + [(500, None), (501, "never seen words"), (None, "w1 w2"), (7, "w1 w1"), (7, "w1 w1")]


def test_scores_match_a_plain_tree(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("clash"), "rare": F.lit(1), "word": F.lit(2)}).repartition(3)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    chance, base, n, unigrams = plain_tree([t for d, t in docs if not held(d)])
    want = []
    for d, t in docs:
        seq = ["<start>", "<start>", *tokens(t)]
        body = seq[2:]
        want.append((
            d if d is not None else -1, held(d), len(body), sum(unigrams[w] > 0 for w in body), n,
            round(sum(math.log10(base(w)) for w in body), 8),
            round(sum(math.log10(chance((seq[i], seq[i + 1]), seq[i + 2])) for i in range(len(body))), 8)))
    got = [(r.doc_id if r.doc_id is not None else -1, *r[1:5], round(r.base_score, 8), round(r.score, 8)) for r in suffix_tree.score(df).collect()]
    assert sorted(got) == sorted(want)
    better = [r for r in got if r[1] and r[2] > 8]
    assert sum(r[6] for r in better) > sum(r[5] for r in better)


def test_rare_words_keep_their_chances(spark):
    """With few symbols most words are of the rare class; known words and base scores do not change."""
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    pick = lambda rows: sorted((r.doc_id or -1, r.n_known, round(r.base_score, 8)) for r in rows)
    assert pick(suffix_tree.score(df, symbols=5).collect()) == pick(suffix_tree.score(df).collect())


def test_every_context_is_a_distribution(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string").filter("text is not null")
    tree, *_ = suffix_tree.learn(df, symbols=30)
    symbols = np.flatnonzero(tree.base > 0)
    assert abs(tree.base.sum() - 1) < 1e-9 and len(tree.levels[0][0])
    contexts = np.concatenate([tree.levels[1][0][:20], tree.levels[0][0][:20], [12345]])
    for c in contexts:
        assert abs(tree.chance(np.full(len(symbols), c), symbols, 2).sum() - 1) < 1e-9


def test_trees_with_the_same_frequent_words_keep_their_own_symbols():
    """Workers hold the words of several models: only the same words share them."""
    import pyarrow as pa

    common = [f"w{i}" for i in range(1000)]
    one, other = (suffix_tree.Tree([*common, *rest], np.zeros(1), []) for rest in (["x", "y"], ["y", "x"]))
    assert one.symbols(pa.array(["x", "y"])).tolist() == [1000, 1001]
    assert other.symbols(pa.array(["x", "y"])).tolist() == [1001, 1000]


def test_scores_of_nothing(spark):
    assert suffix_tree.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    (r,) = suffix_tree.score(one, F.lit(False)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (1, 1, 1)
    (r,) = suffix_tree.score(one.withColumn("text", F.lit("a b")), F.lit(True)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


DOCUMENT = "doc_id long, text string, lang string, source string, n_chars long"


def labelled(n):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            text = [w.upper() + "!!" for w in text]
        if toxic:
            text.insert(3, "nasty")
        docs.append((i, " ".join(text), None if i % 11 == 0 else "en", f"src{i % 3}", 0))
        if i % 2 == 0:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_classifier_finds_held_out_documents(spark):
    docs, labels = labelled(700)
    df = spark.createDataFrame([*docs, (9000, None, None, None, None), (None, "word1 word2", "en", "s", 1)], DOCUMENT).withColumns(
        {"y": F.lit("clash"), "stats": F.lit(0)})
    known = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (3, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    rows = cotrain.classify(df, known).collect()
    assert len(rows) == 702 and rows[0].y == "clash"
    odd = [r for r in rows if r.doc_id is not None and r.doc_id < 700 and r.doc_id % 2 == 1]
    assert sum(r.quality_keep == (r.doc_id % 5 != 0 and r.doc_id % 7 != 0) for r in odd) / len(odd) > 0.97
    assert all(0 <= r.quality_score <= 1 for r in rows)


def test_classifier_replaces_columns_of_its_names(spark):
    docs = spark.createDataFrame([(1, "a b", "en", "s", 3, "x", 1)], "doc_id long, text string, lang string, source string, n_chars int, quality_text string, Quality_Keep int")
    out = cotrain.classify(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "quality_text", "quality_meta", "quality_score", "quality_keep"]
    assert out.first().quality_keep is True


def test_classifier_without_two_kinds_of_labels_keeps_all(spark):
    docs, _ = labelled(20)
    df = spark.createDataFrame(docs, DOCUMENT)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.quality_keep for r in cotrain.classify(df, none).collect())
    one = spark.createDataFrame([(i, 0, 0) for i in range(20)], none.schema)
    assert all(r.quality_keep for r in cotrain.classify(df, one).collect())
    assert cotrain.classify(df.limit(0), none).count() == 0


def test_views_teach_each_other():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        good = i % 2
        stats = np.array([rng.normal(good, 0.3), *rng.normal(0, 1, 6)])
        rows.append((stats, np.array([7] if good else [9], "<i4"), np.array([good, 70, 100]), float(good) if i < 200 else None))
    model = cotrain.co_train(rows)
    t, m, both = model.scores(np.array([r[0] for r in rows]), [r[1] for r in rows], np.array([r[2] for r in rows]))
    truth = np.arange(1200) % 2 == 1
    assert ((t > 0.5) == truth).mean() > 0.98 and ((m > 0.5) == truth).mean() > 0.98 and ((both > 0.5) == truth).mean() > 0.98


def test_pipeline_stages(spark, tmp_path):
    docs, labels = labelled(160)
    passage = " ".join(f"shared{i}" for i in range(60))
    docs = [(i, t + ("\n" + passage if i % 10 in (1, 3) else ""), la, so, len(t)) for i, t, la, so, _ in docs]
    docs += [(1000 + i, docs[1][1] + " tail", "en", "src0", 9) for i in range(3)]
    spark.createDataFrame(docs, DOCUMENT).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "simhash near-dedup", "best-fit packing"]
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 3:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        before, now = now, spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k == 0:
            assert {r.doc_id for r in now.collect()} <= {r.doc_id for r in before.collect()}
        if k == 1:
            assert sum(passage in r.text for r in now.collect()) == 1 and all(len(r.text) == r.n_chars for r in now.collect())
        if k == 2:
            assert now.groupBy("text").count().filter("count > 1").count() == 0
    assert {r.doc_id for r in now.select("doc_id").collect()} == {r.doc_id for r in before.select("doc_id").collect()}


def test_pipeline_drops_near_copies(spark):
    words = [f"w{i}" for i in range(400)]
    copy = ["x" if i in (50, 150, 250, 350) else w for i, w in enumerate(words)]  # similarity 0.90, 5-word shingles
    other = ["x" if i % 40 == 5 else w for i, w in enumerate(words)]  # 0.77
    docs = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(other))]
    now = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], DOCUMENT)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, now, "").collect()) == [1, 3]


def speech(rng, lang, words, bad):
    """Words of a language; telling ones are every tenth of a bad text and every 250th of a good one."""
    return [f"sale{rng.randrange(9)}" if rng.random() < (0.1 if bad else 0.004) else f"{lang}{int(rng.paretovariate(0.7)) % 5000}" for _ in range(words)]


def test_long_clean_documents_stay_in_every_language(spark):
    rng, docs, labels = random.Random(3), [], []
    for i in range(640):
        bad, lang = i % 4 == 0, ("en", "de", "es", "fr")[i // 4 % 4]
        docs.append((i, " ".join(speech(rng, lang, rng.randint(80, 300), bad)), lang, "s", 0))
        labels.append((i, int(not bad), 0))
    for k, lang in enumerate(("en", "de", "es", "fr")):
        for size in (10_000, 40_000, 100_000):
            docs += [(10_000 + size + 2 * k + bad, " ".join(speech(rng, lang, size, bad)), lang, "s", 0) for bad in (0, 1)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = cotrain.classify(spark.createDataFrame(docs, DOCUMENT), known).filter("doc_id >= 10000").collect()
    assert len(rows) == 24 and {r.doc_id for r in rows if r.quality_keep} == {r.doc_id for r in rows if r.doc_id % 2 == 0}


def test_long_labelled_documents_are_learned_from(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(speech(rng, "en", 25_000, i % 2)), "en", "s", 0) for i in range(60)]
    known = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(48)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.quality_keep for r in cotrain.classify(spark.createDataFrame(docs, DOCUMENT), known).collect()}
    assert got == {i: i % 2 == 0 for i in range(60)}
