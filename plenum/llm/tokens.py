"""Token ids of whole texts by the tokenizers library, with a bounded memory of chunks met before.

A byte-level BPE tokenizer always starts a new pre-token at a space that precedes a character other
than white space, so a text may be cut there and each chunk encoded alone. Most chunks are frequent
words; each worker keeps the ids of those that it has met, up to a number of bytes. Texts of Latin letters are cut
into pre-tokens by the pattern of byte-level BPE and each goes to the library's model once. A text that holds one of the
tokenizer's added tokens, such as ``<|endoftext|>``, goes to the library whole, which gives that token's id for it.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import islice

import numpy as np

#: Bytes of a worker's memory of chunks, and of that of pre-tokens.
MEMORY = 160 << 20
_CUT = re.compile(r"(?= \S)")
#: A space after which no chunk starts.
_ODD = re.compile(r" (?=\s|$)")
#: Characters whose classes are the same in every version of Unicode and every pattern engine.
_PLAIN = re.compile(r"[\n -~\xa1-\xac\xae-\u024f]*")
_LETTERS, _NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Fixed value: the pattern by which byte-level BPE cuts texts, with its classes written out for the plain characters.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Memory(dict):
    """Ids by text, of about ``most`` bytes; ``trim`` forgets the older half when there are more."""

    #: A key and a value of a few characters with their places in the table.
    ENTRY = 230

    def __init__(self, most: int):
        super().__init__()
        self.entries = max(1, most // self.ENTRY)

    def trim(self) -> None:
        if len(self) > self.entries:
            for key in list(islice(self, len(self) // 2)):
                del self[key]


class Encoder:
    """``encode(text)`` gives the ids as little-endian bytes of ``dtype``: those of the library's ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        self.by_chunk = (
            spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and before.get("type") == "ByteLevel"
            and before.get("use_regex", True)
            and not before.get("add_prefix_space")
        )
        self.model = self.library.model
        self.letters = {i: c for i, c in enumerate(_byte_letters())}
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.known, self.pieces = Memory(memory), Memory(memory)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Latin words are one pre-token each and go straight to the library's model."""
        out: list[bytes | None] = []
        rest = []
        for c in chunks:
            word = c[1:] if c[:1] == " " else c
            if word.isalpha() and max(word) < "ɐ":
                piece = c.encode().decode("latin-1").translate(self.letters)
                out.append(np.array([t.id for t in self.model.tokenize(piece)], self.dtype).tobytes())
            else:
                out.append(None)
                rest.append(c)
        more = iter(self._whole(rest)) if rest else iter(())
        return [next(more) if x is None else x for x in out]

    def _known(self, keys: list[str]) -> list[bytes]:
        """A key with a space in front stands for its chunk without, any other key for its chunk with one."""
        found = list(map(self.known.get, keys))
        if None in found:
            new = list({k: None for k, f in zip(keys, found) if f is None})
            self.known.update(zip(new, self._chunks([k[1:] if k[:1] == " " else " " + k for k in new])))
            found = list(map(self.known.__getitem__, keys))
            self.known.trim()
        return found

    def _plain(self, text: str) -> bytes:
        pieces = _PIECES.findall(text)
        try:
            return b"".join(map(self.pieces.__getitem__, pieces))
        except KeyError:
            pass
        code, tokenize, letters, known = self.dtype.char, self.model.tokenize, self.letters, self.pieces
        for p in pieces:
            if p not in known:
                known[p] = array(code, [t.id for t in tokenize(p.encode().decode("latin-1").translate(letters))]).tobytes()
        out = b"".join(map(known.__getitem__, pieces))
        known.trim()
        return out

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_chunk or any(map(text.__contains__, self.added)):
            return self._whole([text])[0]
        if _PLAIN.fullmatch(text):
            return self._plain(text)
        if _ODD.search(text):
            chunks = [c for c in _CUT.split(text) if c]
            return b"".join(b"".join(self._known([c[1:]])) if c[0] == " " and c.count(" ") == 1 else self._whole([c])[0] for c in chunks)
        parts = text.split(" ")
        if parts[0]:
            parts[0] = " " + parts[0]
        else:
            del parts[0]
        return b"".join(self._known(parts))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
