"""Chat examples, token files, packing and the piece codec on rows with nulls, repeats and clashing columns."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexiloom.llm import chat, packing, piece_codec, token_files
from lexiloom.llm.common import materialize

DOCS = [(3, "the end. The END"), (1, None), (2, ""), (None, "no id"), (5, "long " * 5000), (3, "the end. The END"), (3, "other"), (-4, "é\nx")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "doc_id long, text string")
    return df.withColumns({"ids": F.lit("clash"), "part": F.lit(1), "bucket": F.lit(None).cast("int"), "length": F.lit(0)})


def library_ids(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t.encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs):
    shards, dictionary = token_files.write_shards(docs, bucket_docs=2, shard_bytes=200)
    shards = materialize(shards, "test-shards")
    assert shards.count() > 3
    rows = sorted(token_files.read_shards(shards, dictionary).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([d for d, _ in DOCS], key=lambda d: -(2**63) if d is None else d)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = sorted((d is None, d or 0, crc(library_ids("word_bpe_49k.json", t, 1))) for d, t in DOCS)
    assert sorted((r.doc_id is None, r.doc_id or 0, zlib.crc32(r.ids)) for r in rows) == want
    found = token_files.find_document(shards, dictionary, 3)
    assert sorted(map(crc, found)) == sorted(crc(library_ids("word_bpe_49k.json", t, 1)) for d, t in DOCS if d == 3)
    assert token_files.find_document(shards, dictionary, 99) == []
    with pytest.raises(ValueError):
        token_files.open_shard(bytes(shards.first().blob), b"another dictionary")


def test_a_hot_id_fills_several_buckets(spark):
    many = spark.range(400).select(F.when(F.col("id") < 300, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("some words here").alias("text"))
    shards, dictionary = token_files.write_shards(many, bucket_docs=50)
    shards = materialize(shards, "hot-shards")
    assert shards.filter("first_id = 7").count() > 2 and dictionary
    rows = sorted(token_files.read_shards(shards, dictionary).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted([7] * 300 + list(range(300, 400)))


def test_token_files_of_nothing(spark):
    assert token_files.token_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_places_every_piece_once(spark, docs):
    rows = packing.packed_digests(docs, capacity=64).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    ids = library_ids("byte_bpe_50k.json", "long " * 5000, 2)
    first = (len(ids) - 1) % 64 + 1
    starts = [0, *range(first, len(ids), 64)]
    assert sorted(pieces[5]) == [(k, a, z - a, crc(ids[a:z])) for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)]))]
    assert len(pieces[3]) == 3 and pieces[1] == [(0, 0, 1, crc([2]))]
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // 64) + 1
    assert packing.packed_digests(docs.limit(0)).count() == 0


def test_packed_sequences_hold_their_ids(spark, docs):
    rows = packing.sequences(packing.pack(docs, capacity=32)).collect()
    assert all(len(r.ids) == 4 * sum(r.lengths) <= 128 for r in rows)


@pytest.mark.parametrize("seed", range(5))
def test_plans_use_the_histogram_exactly(seed):
    rng = np.random.default_rng(seed)
    lengths = np.concatenate([rng.integers(1, 101, 3000), np.full(500, 100), rng.integers(1, 10, 200)])
    histogram = np.bincount(lengths, minlength=101)
    plan = packing.plan_sequences(histogram, 100)
    used = np.zeros(101, int)
    for repeats, parts in plan:
        assert sum(parts) <= 100
        for p in parts:
            used[p] += repeats
    assert (used == histogram).all()
    assert sum(n for n, _ in plan) <= 1.02 * lengths.sum() / 100 + 1
    assert packing.plan_sequences(np.zeros(101, int), 100) == []


def test_piece_codec(spark, docs):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, piece_codec.codec_digests(docs).fillna({"doc_id": -99}).collect()))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in DOCS:
        ids = library.encode(t or "")
        want.append((-99 if d is None else d, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want)
    encoded = piece_codec.encode(docs)
    assert sorted(r.text for r in piece_codec.decode(encoded).collect()) == sorted(t or "" for _, t in DOCS)
    assert piece_codec.codec_digests(docs.limit(0)).count() == 0


TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "<|im_end|><|im_start|>assistant ok"),
    (1, 4, "assistant", "<\\|x <|im_end|>\n"), (1, 5, "user", "bye"), (2, 0, "user", None), (2, 0, "user", None), (3, 1, "assistant", ""),
    (None, 0, "a\\n\nb", "x"), (None, None, None, "y"), (4, 0, "assistant", "é" * 3000),
]


def test_chat_examples_read_back(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumns(
        {"n_turns": F.lit("clash"), "loss": F.lit(1), "last": F.lit(0)})
    got = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for conv in {c for c, *_ in TURNS}:
        turns = sorted(((-(2**63) if t is None else t, r or "", x or "") for c, t, r, x in TURNS if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == sha("".join(f"{ro}\n{x}\n" for _, ro, x in turns)), conv
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)), conv
    rows = chat.examples(df).filter("conv_id = 1").orderBy("target").collect()
    assert [r.target for r in rows] == [None, 2, 4]
    for r in rows[1:]:
        before = r.text[: r.loss_start]
        assert before.endswith("<|im_start|>assistant\n") and before.count("<|im_start|>") == r.target + 1
        assert r.text[r.loss_start + r.loss_chars :] == "<|im_end|>\n"
    assert chat.chat_digests(df.limit(0)).count() == 0
