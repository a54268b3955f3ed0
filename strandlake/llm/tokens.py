"""Tokenization by the tokenizers library, with a memo of words.

Both public vocabularies cut a text before every white-space character that follows a character of another
kind, and behind every run of letters that an ASCII character follows, whatever else stands around.  A
text's ids are therefore the ids of its units, one after another, and a unit's ids can be kept.  A unit is
a word of Latin-1 letters, perhaps with one space or line end before it, or else a run of ASCII white space
and the run of other characters after it.  A word that isn't known yet goes to the library's BPE model
straight away; all other units, and texts with other white space, where a run could go on across a unit's
end, go through its whole pipeline.  The memo keeps at most two generations of a bounded number of units,
which changes no result.

Strings of added tokens (such as <|endoftext|>) in a text become those tokens, as in the library; what stands
between them is encoded piece by piece.  With `special_as_text` strings of special tokens are ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

#: Latin-1 letters: one code point each in every normal form, letters to both vocabularies' patterns.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ÿ]"
_UNITS = re.compile(f"[ \n]?{_LETTER}++(?![^\x00-\x7f])|[ \t-\r]*[^ \t-\r]+|[ \t-\r]+").findall
_PLAIN = re.compile(f"{_LETTER}+").fullmatch
#: White space beyond ASCII's, and what comes close to it.
_OTHER_SPACE = [chr(c) for c in (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
_LONGEST = 64  # code points of a unit worth keeping


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, else the next code point from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()
_PROBES = ["a", "The", " the", "\nThe", " internationalization", " Straße", "été", " ÀÉÎ", "\nthought", " s", " t", "ye", " zzzqxj"]


class _Units(dict):
    """The ids of units, looked up or made; what wasn't used since the turn before last is forgotten."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.make(unit)
        if len(unit) <= _LONGEST:
            self[unit] = ids
        return ids

    def turn(self) -> None:
        self.old = dict(self)
        self.clear()


class Encoder:
    """encode(texts) -> for each text its ids as little-endian unsigned 32-bit integers, in bytes."""

    def __init__(self, vocabulary: str, most_units: int = 350_000, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the cores already
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = special_as_text
        added = {k: t for k, t in self.tokenizer.get_added_tokens_decoder().items() if not (t.special and special_as_text)}
        #: Added tokens that stand for their exact strings; where any is of another kind, the library does it all.
        self.added = {t.content: array("I", [k]).tobytes() for k, t in added.items()}
        self.exact = not any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values())
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split if longest else None
        self.most = most_units
        self.known = _Units(self._make)
        self.model = self.tokenizer.model
        self.line = self._whole(["\n"])[0]
        whole = self._whole(_PROBES)
        self.form = next((f for f in (self._spaced, self._lowered) if [f(x) for x in _PROBES] == whole), None)

    def _make(self, unit: str) -> bytes:
        form = self.form
        ids = form(unit) if form is not None and len(unit) <= _LONGEST else None
        return self._whole([unit])[0] if ids is None else ids

    def _spaced(self, unit: str) -> bytes | None:
        """The ids of a word where a space before it is part of it and case counts; None for all else."""
        first = unit[0]
        word = unit[1:] if first in " \n" else unit
        if not word.isascii():
            if _PLAIN(word) is None:
                return None
            word = word.encode().decode("latin-1").translate(_LETTERS)
        elif not word.isalpha():
            return None
        ids = array("I", [t.id for t in self.model.tokenize("Ġ" + word if first == " " else word)]).tobytes()
        return self.line + ids if first == "\n" else ids

    def _lowered(self, unit: str) -> bytes | None:
        """The same where case and the space before a word don't count."""
        word = unit[1:] if unit[0] in " \n" else unit
        if not word.isascii():
            if _PLAIN(word) is None:
                return None
            word = word.lower().encode().decode("latin-1").translate(_LETTERS)
        elif not word.isalpha():
            return None
        return array("I", [t.id for t in self.model.tokenize(word.lower() if word.isascii() else word)]).tobytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _one(self, text: str) -> bytes:
        if not self.exact or any(c in text for c in _OTHER_SPACE):
            return self._whole([text])[0]
        return b"".join(map(self.known.__getitem__, _UNITS(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if self.exact and any(x in text for x in self.added):
                out.append(b"".join(self.added.get(x) or self._one(x) for x in self.cut(text) if x))
            else:
                out.append(self._one(text))
            if len(self.known) > self.most:
                self.known.turn()
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for each vocabulary and Python process; worker processes live on across tasks."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def sized_batches(batches, text_at: int = 1, most_bytes: int = 4 << 20):
    """Slices of Arrow batches with about `most_bytes` of text each, so that long texts don't pile up."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(text_at)), 0).to_pylist()
        begin = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held >= most_bytes:
                yield b.slice(begin, i + 1 - begin)
                begin, held = i + 1, 0
        if begin < len(sizes):
            yield b.slice(begin)
