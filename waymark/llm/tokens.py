"""Ids of a byte-level BPE file, exactly as its tokenizer gives them, by pieces kept in memory."""

from __future__ import annotations

import base64
import re
from functools import lru_cache
from struct import pack

import numpy as np

from waymark.llm.common import SPACES

# A piece is white space and what follows it: the tokenizer never joins what lies on both sides of such a start.
PIECE = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
# Letters and signs that every Unicode table in use classes alike.
PLAIN = re.compile("[\t-\r -~\xa0-\u024f]*")


@lru_cache(maxsize=4)
def _library(file: str):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(file))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@lru_cache(maxsize=4)
def _ranked(file: str):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(file), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}
    return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Memory:
    """A bounded memory in two halves: a full newer half becomes the older one, and what is used again comes back from it."""

    def __init__(self, room: int):
        self.room, self.new, self.old = room, {}, {}

    def turn(self) -> dict:
        if len(self.new) > self.room:
            self.new, self.old = {}, self.new
        return self.new

    def again(self, key):
        got = self.old.get(key)
        if got is not None:
            self.new[key] = got
        return got


class ByteEncoder:
    """
    ``ids(text)``: ids as little-endian 32-bit bytes. The memory of pieces is bounded.

    Plain pieces go through the same vocabulary as ranks, which is faster; pieces with other characters or
    with a special token through the tokenizer itself.
    """

    def __init__(self, file: str, room: int = 400_000):
        self.library, self.ranked = _library(file), _ranked(file.replace(".json", ".tiktoken"))
        self.special = re.compile("|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "(?!)")
        self.memory = Memory(room)

    def _piece(self, piece: str) -> bytes:
        if PLAIN.fullmatch(piece) and not self.special.search(piece):
            found = self.ranked.encode_ordinary(piece)
        else:
            found = self.library.encode(piece, add_special_tokens=False).ids
        return np.array(found, "<u4").tobytes() if len(found) > 64 else pack(f"<{len(found)}I", *found)

    def ids(self, text: str) -> bytes:
        memory, out = self.memory.turn(), []
        for piece in PIECE.findall(text):
            got = memory.get(piece)
            if got is None and (got := self.memory.again(piece)) is None:
                got = self._piece(piece)
                if len(piece) <= 64:
                    memory[piece] = got
            out.append(got)
        return b"".join(out)


@lru_cache(maxsize=4)
def byte_encoder(file: str) -> ByteEncoder:
    """One per Python worker: the pieces a task has met serve the next."""
    return ByteEncoder(file)
