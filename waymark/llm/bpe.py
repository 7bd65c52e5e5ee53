"""
BPE encoding and decoding with forced boundaries.

Two symbols that never stand side by side inside any token of the vocabulary can never be merged across, so
every such place is a certain cut. A text is cut at white space, at the pre-tokenizer's borders and at those
pairs; the fragments are merged each on its own by rank and their ids put one after the other. Fragments repeat
far more than words do, so a bounded memory of them serves most of the text.

Null texts count as empty: no ids, empty decoded text. Repeated rows are each encoded. Texts are whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers.models import BPE

from waymark.llm.common import SPACES, texts
from waymark.llm.tokens import Memory, _library

FILE = "word_bpe_49k.json"
SPLIT = re.compile(f"[^{SPACES}]+")
END = "</w>"
# Composed letters and signs, which normal form leaves alone and every Unicode table classes alike.
PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]*")
# Bytes as characters: printable Latin-1 as it is, the rest in order from 256 on.
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTES = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*SHOWN}))}


class Vocabulary:
    """Merges, ids and the pairs of symbols that occur inside tokens, of a BPE file with word ends."""

    def __init__(self, file: str):
        import public_tokenizers

        with open(public_tokenizers.path(file), encoding="utf-8") as source:
            whole = json.load(source)
        model, first = whole["model"], whole["pre_tokenizer"]["pretokenizers"][0]
        self.border = regex.compile(first["pattern"]["Regex"])
        self.ids: dict[str, int] = model["vocab"]
        self.merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.inside = {pair for token in self.ids for symbols in [symbols_of(token)] for pair in zip(symbols, symbols[1:])}


def symbols_of(word: str) -> list[str]:
    """The characters of a token, its end mark joined to the last."""
    if word.endswith(END) and len(word) > len(END):
        body = word[: -len(END)]
        return [*body[:-1], body[-1] + END]
    return list(word)


@lru_cache(maxsize=2)
def vocabulary(file: str) -> Vocabulary:
    return Vocabulary(file)


class Encoder:
    def __init__(self, file: str = FILE, room: int = 250_000):
        self.library, self.vocab = _library(file), vocabulary(file)
        self.last, self.middle = self.library.model, BPE(vocab=self.vocab.ids, merges=self.vocab.merges)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.added = added
        self.special = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")
        self.words, self.chunks = Memory(room), Memory(room)

    def fragments(self, word: str) -> list[str]:
        """The stretches of a piece between certain cuts."""
        symbols = [*word[:-1], word[-1] + END]
        inside = self.vocab.inside
        cuts = [i for i, pair in enumerate(zip(symbols, symbols[1:]), 1) if pair not in inside]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)])]

    def word(self, word: str) -> tuple[list[str], list[int]]:
        """Tokens and ids of a piece: each fragment merged on its own; only the last one has the end mark."""
        *middle, last = self.fragments(word)
        found = [token for fragment in middle for token in self.middle.tokenize(fragment)] + self.last.tokenize(last)
        return [t.value for t in found], [t.id for t in found]

    def pieces(self, part: str):
        """Normalised pieces, bytes as characters; plain letters and signs need no call of the library."""
        if not PLAIN.fullmatch(part):
            return [piece for piece, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))]
        found = self.vocab.border.findall(part.lower())
        return found if part.isascii() else ["".join([BYTES[b] for b in piece.encode("utf-8")]) for piece in found]

    def chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids and decoded text of a stretch without white space."""
        tokens, ids, words = [], [], self.words.turn()
        for part in self.special.split(chunk) if self.special.search(chunk) else [chunk]:
            if part in self.added:
                tokens.append(part)
                ids.append(self.added[part])
            elif part:
                for piece in self.pieces(part):
                    got = words.get(piece)
                    if got is None and (got := self.words.again(piece)) is None:
                        got = self.word(piece)
                        if len(piece) <= 64:
                            words[piece] = got
                    tokens += got[0]
                    ids += got[1]
        return pack(f"<{len(ids)}I", *ids), " ".join(tokens)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit bytes, and the decoded text."""
        chunks, ids, tokens = self.chunks.turn(), [], []
        for piece in SPLIT.findall(text):
            got = chunks.get(piece)
            if got is None and (got := self.chunks.again(piece)) is None:
                got = self.chunk(piece)
                if len(piece) <= 64:
                    chunks[piece] = got
            if got[0]:
                ids.append(got[0])
                tokens.append(got[1])
        return b"".join(ids), " ".join(tokens)


@lru_cache(maxsize=2)
def encoder_of(file: str) -> Encoder:
    """One per Python worker: what a task has merged serves the next."""
    return Encoder(file)


def _encoded(batches, full):
    encoder = encoder_of(FILE)
    for batch in batches:
        found = [encoder.encode(t) for t in batch.column("text").to_pylist()]
        columns = [batch.column("doc_id"), pa.array([len(i) // 4 for i, _ in found], pa.int64())]
        if full:
            columns += [pa.array([np.frombuffer(i, "<u4").astype(np.int64) for i, _ in found], pa.list_(pa.int64())), pa.array([d for _, d in found])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])
        else:
            columns.append(pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()))
            columns.append(pa.array([hashlib.sha256(d.encode("utf-8")).hexdigest() for _, d in found], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text."""
    return texts(docs).mapInArrow(lambda b: _encoded(b, True), "doc_id long, n_tokens long, ids array<bigint>, decoded string")


def digests(docs: DataFrame) -> DataFrame:
    """``encode`` with ids and decoded text taken to digests where they arise."""
    return texts(docs).mapInArrow(lambda b: _encoded(b, False), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
