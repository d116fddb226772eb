"""Byte-level BPE through the ``tokenizers`` library, with a bounded memory of words.

The library's pre-tokenizer always cuts before a space that is followed by a character that
is not white space, so ids can be looked up chunk by chunk. A chunk of letters is one piece,
one with a closing mark is two; other chunks are cut by the pre-tokenizer's own pattern.
Unknown pieces go to the library, many at a time. The ids are those of encoding the whole
text at once (tests compare them). A text that contains an added token (a literal
``<|endoftext|>``) goes to the library whole and gets that token's own id.

The memory lives as long as the Python worker, in two halves of ``HALF`` chunks: when the
young one is full it becomes the old one, and what is used again moves back.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import regex
from tokenizers import Tokenizer

HALF = 400_000

# The byte-level pre-tokenizer's pattern.
PIECES = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
MARKS = frozenset(".,;:!?")
#: A byte-level model writes printable bytes as themselves and the others, in order, from U+0100.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
BYTES = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
_LOADED: dict[str, "Encoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> "Encoder":
    """The encoder of a vocabulary file, one for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    return _LOADED[path]


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        small = self.tokenizer.get_vocab_size() <= 1 << 16
        self.code, self.dtype = ("H", "<u2") if small else ("I", "<u4")
        self.young: dict[str, bytes | bool] = {}
        self.old: dict[str, bytes | bool] = {}
        self.marks = dict(zip(MARKS, self._encode_pieces(list(MARKS))))

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that the pre-tokenizer leaves whole, straight from the model."""
        tokenize, code, space = self.tokenizer.model.tokenize, self.code, BYTES[32]
        out = []
        for p in pieces:
            if p.isascii() and p[0] == " " and p[1:].isalpha():
                p = space + p[1:]
            else:
                p = p.encode("utf-8", "surrogatepass").decode("latin-1").translate(BYTES)
            out.append(array(code, [t.id for t in tokenize(p)]).tobytes())
        return out

    def _cut(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that the pattern cuts into pieces."""
        cut = [PIECES.findall(t) for t in texts]
        pieces = list({p for ps in cut for p in ps})
        known = dict(zip(pieces, self._encode_pieces(pieces)))
        return [b"".join([known[p] for p in ps]) for ps in cut]

    def _learn(self, chunks: set[str]) -> None:
        """Chunks stand behind a space; False marks those that can't be cut off there."""
        young, old = self.young, self.old
        letters, marked, other = [], [], []
        for c in chunks:
            if c in old:
                young[c] = old[c]
            elif c.isalpha():
                letters.append(c)
            elif c[-1:] in MARKS and c[:-1].isalpha():
                marked.append(c)
            elif c and not c[0].isspace():
                other.append(c)
            else:
                young[c] = False
        stems = {c[:-1] for c in marked}.difference(young, letters)
        for c in [c for c in stems if c in old]:
            young[c] = old[c]
            stems.discard(c)
        letters.extend(stems)
        young.update(zip(letters, self._encode_pieces([" " + c for c in letters])))
        for c in marked:
            young[c] = young[c[:-1]] + self.marks[c[-1]]
        young.update(zip(other, self._cut([" " + c for c in other])))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text; null texts are empty."""
        if len(self.young) > HALF:
            self.young, self.old = {}, self.young
        whole = {i: t for i, t in enumerate(texts) if t and any(x in t for x in self.added)}
        if whole:
            texts = [None if i in whole else t for i, t in enumerate(texts)]
        firsts, rests, found, gaps = [], [], [], []
        unknown: set[str] = set()
        known = self.young.get
        for t in texts:
            rest = (t or "").split(" ")
            firsts.append(rest.pop(0))
            rests.append(rest)
            ids = list(map(known, rest))
            gap = [i for i, x in enumerate(ids) if x is None] if None in ids else ()
            unknown.update([rest[i] for i in gap])
            found.append(ids)
            gaps.append(gap)
        self._learn(unknown)
        young, out = self.young, []
        for text, first, rest, ids, gap in zip(texts, self._cut(firsts), rests, found, gaps):
            for i in gap:
                ids[i] = young[rest[i]]
            try:
                joined = first + b"".join(ids)
            except TypeError:  # a space before white space or the end
                joined = self._cut([text])[0]
            out.append(np.frombuffer(joined, self.dtype))
        for i, t in whole.items():
            out[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.dtype)
        return out
