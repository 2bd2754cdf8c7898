"""Encoders against the libraries on whole texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
import sentencepiece

from lexiloom.llm.encoding import PieceEncoder
from lexiloom.llm.piece_codec import PieceCodec

PARTS = [*"ab'st ré１  \n\t\r\x0b\x0c\x1c\x85\xa0　.,!9Σς é ﬁ ▁中😀<|>\x00", "<|endoftext|>", "<s>", "<0x0A>", "'s", "the ", " ation", "   "]


def odd_texts(n):
    rng = random.Random(n)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(n)] + [
        "", " ", "\n", "a" * 300, " " * 90 + "x", "word " * 4000, "é" * 50 + ". " + "The THE the, the."]


@pytest.mark.parametrize("name,spaces", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")])
def test_pieces_encode_like_whole_texts(name, spaces):
    encoder = PieceEncoder(open(public_tokenizers.path(name), "rb").read(), spaces)
    texts = odd_texts(3000)
    want = [np.array(encoder.full.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encoder.encode(pa.array(texts)).to_pylist() == want
    assert encoder.encode(pa.array(texts).slice(7, 50)).to_pylist() == want[7:57]
    assert len(encoder.encode(pa.array([], pa.string()))) == 0


def test_prefix_table_encodes_and_decodes_like_the_library():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, library = PieceCodec(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    texts = odd_texts(3000)
    n, ids, said = codec.described(pa.array(texts))
    for t, k, i, d in zip(texts, n, ids.to_pylist(), said.to_pylist()):
        want = library.encode(t)
        assert (k, i, d) == (len(want), ",".join(map(str, want)), library.decode(want)), t
        assert codec.decode(want) == d
    rng = random.Random(1)
    for _ in range(500):
        some = [rng.choice((rng.randrange(32_000), rng.randrange(259))) for _ in range(rng.randint(0, 6))]
        assert codec.decode(some) == library.decode(some)


def test_prefix_table_is_the_merge_result():
    codec = PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    for t in ("▁the", "▁internationalisation", "▁▁▁▁▁x", "aaaaaaa", "▁ééé"):
        assert [codec.pieces[i] for i in codec.encode_cut(t)] == codec.merge(t)
