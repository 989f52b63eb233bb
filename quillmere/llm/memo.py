"""Tokenizers that remember what the library gave for each chunk of a text.

Neither vocabulary lets a token cross certain white space, so the tokens of a
text are the tokens of its chunks in order:

* ``WordMemo``: the pre-tokenizer of a vocabulary that removes white space keeps
  no piece with white space in it, and normalisation never composes across it.
  A text is cut at every run of white space.
* ``SpaceMemo``: the byte-level pre-tokenizer attaches one space to what
  follows. A space between two characters that are not white space always
  begins a new piece, whatever stands further left or right, so a text is cut
  before each such space. Other white space stays inside its chunk.

The library itself encodes each chunk when it is first seen, special strings
included (they hold no white space). A chunk of small Latin-1 letters and then ASCII punctuation is
given to the library's BPE alone, in the two pieces that the vocabulary's pattern makes of it, where normaliser and pattern are those that ``_PLAIN_STEPS`` names: they change
nothing else in it, and a special string has letters after punctuation. To have fewer different chunks, closing
punctuation after a Latin-1 letter and before white space is a chunk of its own (both
pre-tokenizers part letters from punctuation), and so is a single line feed; texts of
Latin-1 characters are lower-cased beforehand where the vocabulary would do it
(such letters change in nothing else).

Memories last as long as a worker process. One that holds ``limit`` bytes becomes
the old one, from which what is met again is taken over, and the one before it is
forgotten; that changes speed and nothing else. Chunks of more than ``LONGEST`` characters
(texts without white space, say) are not remembered; ``WordMemo`` cuts those of more than ``CUT`` where a piece ends
for certain: after an ASCII digit, which is a piece by itself, before an ASCII letter or digit, and
between punctuation and letters of Chinese or Japanese, where nothing is composed.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Characters of a chunk that is remembered, and from which on a chunk is cut further.
LONGEST, CUT = 64, 4096
#: Bytes of a memory.
LIMIT = 48 << 20
#: Whether this machine's unsigned integers are little-endian ones of 32 bits.
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4

#: Characters that Python's split takes as white space but the vocabulary's pattern does not.
_PYTHON_ONLY = re.compile("[\x1c-\x1f]")
#: White space other than the space, tab, line feed and carriage return.
_RARE_SPACE = re.compile("[\\x0b\\x0c\\x1c-\\x1f\\x85\\xa0\\u1680\\u180e\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_NEAR_SPACE = ("  ", " \n", "\n ", " \t", "\t ", " \r", "\r ")
_SAFE_SPACE = re.compile("(?<=[^\\s\\u180e]) (?=[^\\s\\u180e])")


def library_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class _Memory(dict):
    def __init__(self, make: Callable[[str], object], limit: int):
        super().__init__()
        self.make, self.limit, self.old, self.size = make, limit, {}, 0

    def __missing__(self, chunk: str) -> object:
        if len(chunk) > LONGEST:
            return self.make(chunk)
        if self.size >= self.limit:
            self.old = dict(self)
            self.clear()
            self.size = 0
        value = self.old.get(chunk)
        if value is None:
            value = self.make(chunk)
        self[chunk] = value
        self.size += 100 + sys.getsizeof(chunk) + sys.getsizeof(value)  # 100: its share of the table
        return value


_SURE = re.compile("(?<=[0-9])(?=[0-9A-Za-z])|(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff])")
#: The letter is looked back to last, so that the search jumps from mark to mark.
CLOSING = re.compile("([.,;:!?])(?=[ \n])(?<=[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff].)")

#: Small Latin-1 letters, then ASCII punctuation but the apostrophe.
_PLAIN = re.compile("([a-z\xdf-\xf6\xf8-\xff]+)([!-&(-/:-@\\[-`{-~]*)")
#: A normaliser and pattern that leave such a chunk's characters alone and part its letters from its punctuation.
_PLAIN_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: What the byte-level step makes of those letters beyond ASCII: its characters for their two bytes in UTF-8.
_BYTE_LEVEL = {c: "\xc3" + chr(0x143 if b == 0xAD else b if b > 0xA0 else b + 0xA2) for c in range(0xC0, 0x100) for b in [chr(c).encode()[1]]}


def _latin1(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordMemo:
    """Token ids of a text, for a vocabulary that lower-cases and removes white space."""

    def __init__(self, path: str, limit: int = LIMIT):
        self.tokenizer = library_tokenizer(path)
        steps = tuple(x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer))
        self.piece = self.tokenizer.model.tokenize if steps == _PLAIN_STEPS and self.tokenizer.post_processor is None else None
        self.memory = _Memory(self._encode, limit)

    def _encode(self, chunk: str) -> bytes:
        plain = self.piece and _PLAIN.fullmatch(chunk)
        if plain:
            letters, marks = plain.groups()
            tokens = self.piece(letters if letters.isascii() else letters.translate(_BYTE_LEVEL))
            ids = [t.id for t in (tokens + self.piece(marks) if marks else tokens)]
        else:
            ids = self.tokenizer.encode(chunk, add_special_tokens=False).ids
        return array("I", ids).tobytes() if _NATIVE else np.asarray(ids, dtype="<u4").tobytes()

    @classmethod
    @lru_cache(maxsize=2)
    def shared(cls, path: str) -> WordMemo:
        """The memo of this process."""
        return cls(path)

    def ids(self, text: str) -> bytes:
        """Token ids of the whole text, each as a little-endian unsigned 32-bit integer."""
        if _PYTHON_ONLY.search(text):
            chunks = [text]
        elif "<|" not in text and _latin1(text):
            chunks = CLOSING.sub(" \\1", text.lower()).split()
        else:
            chunks = text.split()
        if len(text) > CUT and any(len(c) > CUT for c in chunks):
            chunks = [part for c in chunks for part in (_SURE.split(c) if len(c) > CUT else (c,))]
        return b"".join(map(self.memory.__getitem__, chunks))


class SpaceMemo:
    """Token counts of a text, for a byte-level vocabulary."""

    #: A chunk with no space before it begins with this; chunks stand for themselves with a space before.
    BARE, LINE = "\x00", "\x01"

    def __init__(self, path: str, limit: int = LIMIT):
        self.tokenizer = tokenizer = library_tokenizer(path)
        count = lambda x: len(tokenizer.encode(x, add_special_tokens=False).ids)
        self.whole = count
        self.memory = _Memory(lambda x: count(x[1:] if x[:1] == self.BARE else "\n" if x == self.LINE else " " + x), limit)

    @classmethod
    @lru_cache(maxsize=2)
    def shared(cls, path: str) -> SpaceMemo:
        """The memo of this process."""
        return cls(path)

    @staticmethod
    def plain(text: str) -> bool:
        """Whether every space stands between characters that are not white space."""
        return not (any(pair in text for pair in _NEAR_SPACE) or text[:1] == " " or text[-1:] == " " or _RARE_SPACE.search(text))

    def count(self, text: str) -> int:
        if self.BARE in text or self.LINE in text:
            return self.whole(text)
        if self.plain(text):
            text = CLOSING.sub(" \0\\1", text)
            if "\n\n" not in text and "\t" not in text and "\r" not in text and text[:1] != "\n" and text[-1:] != "\n":
                text = text.replace("\n", " \x01 \0")
            chunks = text.split(" ")
        else:
            chunks = _SAFE_SPACE.split(text)
        chunks[0] = self.BARE + chunks[0]
        return sum(map(self.memory.__getitem__, chunks))
