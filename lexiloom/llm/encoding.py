"""Whole-text encoding with the tokenizers library, each distinct piece once.

Both pre-tokenizers used here never let a token cross certain white space, so texts are cut there, a batch of
texts is turned into its distinct pieces with Arrow's kernels, the library encodes those, and the ids of a text
are the ids of its pieces in order.  The result is that of encoding the whole text at once (tests compare the
two on random Unicode texts).
"""

from __future__ import annotations

import os
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import SparkSession

from .common import once_per_worker

#: Words kept by a worker from batch to batch: the first that it meets, which frequent words are among.
KEPT_WORDS = 250_000
#: UTF-8 bytes of text that are encoded at a time, which bounds what a batch takes besides its result.
SLICE_BYTES = 6 << 20
#: A word and marks after it, and as much after a line feed, for which pre-tokenizing is known: a token for each.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,!?;:|#$%&*()/-"
PLAIN = f"^(?P<word>[{LETTERS}]*)(?P<marks>[{MARKS}]*)(?:(?P<line>\\n)(?P<word2>[{LETTERS}]+)(?P<marks2>[{MARKS}]*))?$"
#: White space of any kind before a blank.
SPACES = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "

_shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Byte-level vocabularies show a byte as itself if it prints, and as the next free code point from 256 if not.
SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _shown)}


def tokenizer_file(path: str | None, name: str) -> str:
    """``path``, or the place of a public tokenizer file when it is None."""
    if path is not None:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def share_file(spark: SparkSession, path: str) -> Broadcast:
    """A vocabulary file (a few MB, as large for any input) for the executors, which need no copy of it."""
    return spark.sparkContext.broadcast(Path(path).read_bytes())


def shown(text: str) -> str:
    return text if text.isascii() and text.isalpha() else text.encode().decode("latin-1").translate(SHOWN)


def in_slices(texts: pa.Array, encode) -> pa.Array:
    """``encode`` for parts of at most SLICE_BYTES, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    out, at = [], 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        out.append(encode(texts.slice(at, end - at)))
        at = end
    return pa.concat_arrays(out) if out else pa.array([], pa.binary())


class PieceEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers.

    ``spaces``: "dropped" if white space only separates tokens and letters become lower case (cut at blank,
    tab, line feed and carriage return); "leading" if one blank joins the word after it (cut before a blank
    that follows a non-blank).  Strings of special tokens inside a text are ordinary text.
    """

    def __init__(self, definition: bytes, spaces: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(definition.decode())
        self.full.encode_special_tokens = True
        self.merges = Tokenizer(self.full.model)  # no normalizing or pre-tokenizing
        self.leading = spaces == "leading"
        self.kept: dict[str, bytes] = {}

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> list[bytes]:
        batch = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        out: list[bytes] = []
        for i in range(0, len(texts), 20_000):  # encodings are large objects
            out += [np.array(e.ids, "<u4").tobytes() for e in batch(texts[i : i + 20_000], add_special_tokens=False)]
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        found = list(map(self.kept.get, words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if missing:
            new = self._ids(self.merges, [shown(words[i]) for i in missing])
            for i, ids in zip(missing, new):
                found[i] = ids
                if len(self.kept) < KEPT_WORDS:
                    self.kept[words[i]] = ids
        return found

    def _pieces(self, pieces: pa.Array) -> pa.Array:
        """Ids of distinct pieces as binary values; pieces of a "leading" tokenizer follow a blank."""
        parts = pc.extract_regex(pieces, PLAIN)
        plain = parts.is_valid()
        columns = {n: pc.fill_null(parts.field(n), "") for n in ("word", "marks", "line", "word2", "marks2")}
        if self.leading:
            plain = pc.and_(plain, pc.not_equal(columns["word"], ""))
            columns["word"] = pc.binary_join_element_wise(" ", columns["word"], "")
        else:
            columns["word"] = pc.utf8_lower(columns["word"])
        ids = []
        for column in columns.values():
            x = pc.if_else(plain, column, "").dictionary_encode()
            ids.append(pa.array(self._words(x.dictionary.to_pylist()), pa.binary()).take(x.indices))
        ids = pc.binary_join_element_wise(*ids, b"")
        odd = pc.invert(plain)
        if pc.any(odd).as_py():
            prefix = " " * self.leading
            own = self._ids(self.full, [prefix + p for p in pieces.filter(odd).to_pylist()])
            ids = pc.replace_with_mask(ids, odd, pa.array(own, pa.binary()))
        return ids

    def encode(self, texts: pa.Array) -> pa.Array:
        """Binary ids of every text, none of which is null."""
        return in_slices(texts, self._encode)

    def _encode(self, texts: pa.Array) -> pa.Array:
        if not self.leading:
            texts, whole = pc.replace_substring_regex(texts, "[\t\n\r]", " "), None
        else:
            whole = pc.match_substring_regex(texts, SPACES)
            odd = texts.filter(whole).to_pylist()
            texts = pc.if_else(whole, "", texts)
        cut = pc.split_pattern(texts, " ")
        pieces = cut.flatten().dictionary_encode()
        ids, at = self._pieces(pieces.dictionary), pieces.indices.to_numpy()
        if self.leading:  # a text's first piece follows no blank
            first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
            own = self._ids(self.full, pieces.dictionary.take(pa.array(at[first])).to_pylist())
            at = at.copy()
            at[first] = len(ids) + np.arange(len(first))
            ids = pa.concat_arrays([ids, pa.array(own, pa.binary())])
        offsets = pc.subtract(cut.offsets, cut.offsets[0])
        out = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.take(pa.array(at))), b"")
        if whole is not None and odd:
            out = pc.replace_with_mask(out, whole, pa.array([self._spaced(t) for t in odd], pa.binary()))
        return out

    def _spaced(self, text: str) -> bytes:
        """Runs of white space stay with the piece they follow a non-blank in."""
        first, *rest = re.split(r"(?<=\S) ", text)
        ids = self._ids(self.full, [first])
        if rest:
            distinct = pa.array(rest, pa.string()).dictionary_encode()
            ids += self._pieces(distinct.dictionary).take(distinct.indices).to_pylist()
        return b"".join(ids)


def encoder(definition: Broadcast, spaces: str) -> PieceEncoder:
    """The worker's encoder; kept over tasks."""
    return once_per_worker(
        ("encoder", hash(definition.value), spaces), lambda: PieceEncoder(definition.value, spaces)
    )
