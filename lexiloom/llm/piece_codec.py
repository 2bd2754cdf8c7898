"""SentencePiece BPE encoding by a merge-type prefix table, and decoding.

Merging the best pair first gives a sequence in which each piece encodes to itself and each two neighbours
stay two pieces when encoded together; and any sequence with these properties is the encoding.  So every
prefix of a text has one last piece, and dropping it leaves the encoding of a shorter prefix.  The table holds
that last piece for every prefix: an automaton gives the pieces that end there, and the one that is compatible
with the last piece of the prefix before it is stored.  Ids are then recovered from the end.

Pieces never hold a blank mark after another character, nor some characters (such as the line feed) at all, so
texts are cut there first, and each distinct cut is encoded once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame

from .common import map_rows, once_per_worker, texts
from .encoding import LETTERS, in_slices, share_file, tokenizer_file

MARK = "▁"
KEPT = 200_000
KEPT_LENGTH = 64


class PieceCodec:
    """Encoder and decoder of one BPE model with byte fallback, a blank put in front, and no normalizing."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = range(sp.get_piece_size())
        self.pieces = [sp.id_to_piece(i) for i in ids]
        special = {i for i in ids if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)}
        self.score = {self.pieces[i]: sp.get_score(i) for i in ids if i not in special}
        self.id = {self.pieces[i]: i for i in ids if i not in special}
        self.byte_id = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.last_special = max(special)
        self.silent = {i for i in ids if sp.is_control(i)}
        self.unknown = sp.unk_id()
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece holds a blank after another character")
        self.characters = {c for p in self.id for c in p}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if self.merge(p) == [p]:  # a piece that merging cannot reach never stands in an encoding
                self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}
        # marks after a letter are a cut of their own if no piece holds the two
        held = {p[k] for p in self.id for k in range(1, len(p)) if p[k - 1].isalpha()}
        self.marks = "".join(c for c in ".,!?;:|$%&#*" if c not in held)
        self.body = f"^(?P<body>.*[{LETTERS}])(?P<marks>[{re.escape(self.marks)}]+)$"
        # a run of blank marks goes with what follows; what no piece holds stands alone
        self.alone = alone = "\n" if "\n" not in self.characters else ""
        self.cut = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+|{alone or MARK}")

    def merge(self, text: str) -> list[str]:
        """Best score first, leftmost among equals: what the table must agree with, for short texts."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _fit(self, a: int, b: int) -> bool:
        """Whether two pieces stay two when encoded together."""
        if len(self.fits) >= KEPT:
            self.fits.clear()
        x, y = self.pieces[a], self.pieces[b]
        known = self.fits[a * len(self.pieces) + b] = self.merge(x + y) == [x, y]
        return known

    def encode_cut(self, text: str) -> list[int]:
        """Ids of one cut, from its prefix table."""
        n, all_ = len(text), len(self.pieces)
        last = [-1] * (n + 1)  # last piece of each prefix; -1: a character of no piece, which merges with nothing
        fits = self.fits
        for end, (size, i) in self.automaton.iter(text):
            if last[end + 1] < 0:
                a = last[end + 1 - size]
                if a >= 0:
                    fit = fits.get(a * all_ + i)
                    if not (self._fit(a, i) if fit is None else fit):
                        continue
                last[end + 1] = i
        out: list[int] = []
        while n:
            i = last[n]
            if i >= 0:
                out.append(i)
                n -= len(self.pieces[i])
            else:
                n -= 1
                out += [self.byte_id[b] for b in reversed(text[n].encode())]
        return out[::-1]

    def encode(self, texts: pa.Array) -> list[list[int]]:
        return [list(map(int, ids.split(","))) if ids else [] for ids in self.described(texts)[1].to_pylist()]

    def described(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Of every text, none of which is null: number of ids, ids in decimal joined by commas, text decoded from them."""
        # runs of blanks, and blank marks in the text itself, need the general cuts
        marked = pc.replace_substring(texts, "\n", " \n") if self.alone else texts
        odd = pc.match_substring_regex(marked, f"^ |  |{MARK}")
        split = pc.split_pattern(pc.if_else(odd, "", marked), " ")
        own = [self.cut.findall(MARK + t.replace(" ", MARK)) for t in texts.filter(odd).to_pylist()]
        pieces = split.flatten().dictionary_encode()
        extra = pa.array([c for cuts in own for c in cuts], pa.string()).dictionary_encode()
        n, ids, said = (np.concatenate(x) if isinstance(x[0], np.ndarray) else pa.concat_arrays(x) for x in zip(
            self._pieces(pieces.dictionary), self._cuts(extra.dictionary.to_pylist())))
        # pieces of the odd texts follow all others; an empty text has the one piece "", which counts for nothing
        at = np.concatenate([pieces.indices.to_numpy(), extra.indices.to_numpy() + len(pieces.dictionary)]).astype(np.int64)
        starts = split.offsets.to_numpy().astype(np.int64)
        starts -= starts[0]
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = odd.to_numpy(zero_copy_only=False)
        sizes = np.diff(starts)
        sizes[odd] = [len(c) for c in own]
        order = starts[:-1].copy()
        order[odd] = len(pieces) + np.cumsum([0, *map(len, own)])[:-1]
        sizes[empty] = 0
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        at = at[np.repeat(order - bounds[:-1], sizes) + np.arange(bounds[-1])]
        offsets = pa.array(bounds, pa.int32())
        of = lambda values: pa.ListArray.from_arrays(offsets, values.take(pa.array(at)))
        counts = np.concatenate([[0], np.cumsum(n[at])])
        return (
            counts[bounds[1:]] - counts[bounds[:-1]], pc.binary_join(of(ids), ","),
            pc.utf8_slice_codeunits(pc.binary_join(of(said), ""), 1),
        )

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Count, ids and text of pieces that follow a blank, or begin with a line feed that no piece holds."""
        parts = pc.extract_regex(pieces, self.body)
        body = pc.if_else(parts.is_valid(), parts.field("body"), pieces).dictionary_encode()
        marks = pc.if_else(parts.is_valid(), parts.field("marks"), "").dictionary_encode()
        a = self._cuts([p if p[:1] == "\n" and self.alone else MARK + p for p in body.dictionary.to_pylist()])
        b = self._cuts(marks.dictionary.to_pylist())
        tail = pc.binary_join_element_wise(pc.if_else(pc.equal(b[1], ""), "", ","), b[1], "")
        return (
            a[0][body.indices.to_numpy()] + b[0][marks.indices.to_numpy()],
            pc.binary_join_element_wise(a[1].take(body.indices), tail.take(marks.indices), ""),
            pc.binary_join_element_wise(a[2].take(body.indices), b[2].take(marks.indices), ""),
        )

    def _cuts(self, cuts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        kept, out = self.kept, []
        for cut in cuts:
            found = kept.get(cut)
            if found is None:
                found = self._describe(cut)
                if len(cut) <= KEPT_LENGTH and len(kept) < KEPT:
                    kept[cut] = found
            out.append(found)
        n, ids, said = zip(*out) if out else ((), (), ())
        return np.array(n, np.int64), pa.array(ids, pa.string()), pa.array(said, pa.string())

    def _describe(self, cut: str) -> tuple[int, str, str]:
        ids = self.encode_cut(cut)
        plain = not ids or min(ids) > self.last_special
        said = "".join([self.pieces[i] for i in ids]).replace(MARK, " ") if plain else self._spell(ids)
        return len(ids), ",".join(map(str, ids)), said

    def _spell(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                out.append(spell_bytes(raw))
                raw = bytearray()
            if i not in self.silent:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(MARK, " "))
        if raw:
            out.append(spell_bytes(raw))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any ids; the blank that encoding puts in front is taken away."""
        text = self._spell(ids)
        first = next((i for i in ids if i not in self.silent), None)
        return text[1:] if first is not None and first not in self.byte_of and self.pieces[first].startswith(MARK) else text


def spell_bytes(raw: bytes) -> str:
    """UTF-8 text; each byte that is part of no character becomes a replacement character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(bytes(raw[i : i + n]).decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            n = 1
            out.append("�")
        i += n
    return "".join(out)


def codec(model: Broadcast) -> PieceCodec:
    return once_per_worker(("codec", hash(model.value)), lambda: PieceCodec(model.value))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) of every whole text.

    Null text is empty and has no ids; repeated and null doc_ids stay as they are; other columns are ignored.
    """
    shared = share_file(docs.sparkSession, tokenizer_file(model, "piece_bpe_32k.model"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield [b.column("doc_id"), codec(shared).encode(b.column("text"))]

    return map_rows(texts(docs), rows, "doc_id long, ids array<int>")


def decode(rows_of_ids: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text of rows of doc_id, ids; null ids are none."""
    shared = share_file(rows_of_ids.sparkSession, tokenizer_file(model, "piece_bpe_32k.model"))

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            yield [b.column("doc_id"), [codec(shared).decode(i or []) for i in b.column("ids").to_pylist()]]

    return map_rows(rows_of_ids.select("doc_id", "ids"), rows, "doc_id long, text string")


def codec_digests(docs: DataFrame, model: str | None = None) -> DataFrame:
    """Encode and decode every whole text; digests of the ids and of the decoded text."""
    shared = share_file(docs.sparkSession, tokenizer_file(model, "piece_bpe_32k.model"))

    def digests(part: pa.Array) -> pa.StructArray:
        n, ids, said = codec(shared).described(part)
        sha = lambda column: pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in column], pa.string())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), sha(ids), sha(said)], ["n", "ids", "said"])

    def rows(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows == 0:
                continue
            made = in_slices(b.column("text"), digests).flatten()
            yield [b.column("doc_id"), *made]

    return map_rows(texts(docs), rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
