"""Token ids of whole texts by a tokenizer file, with the ids of repeated words kept.

Both vocabularies of the library cut a text into pre-tokens before any merge, and merges never
leave a pre-token.  A text can therefore be cut wherever a pre-token must end and its chunks
encoded on their own: the ids are those of the whole text.  Natural text repeats its words, so a
worker asks the tokenizer once for each word it meets and keeps the answer for its later tasks.
Texts with anything that could reach across a cut (runs of white space, unusual white space,
special tokens) go to the tokenizer whole.
"""

from __future__ import annotations

import functools
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np

#: A worker forgets its chunks when there are so many (about 200 bytes each); only speed depends
#: on it.
KEPT_CHUNKS = 1_000_000

#: White space other than blanks and newlines; the last four separate words for ``str.split`` only.
_UNUSUAL = (
    *"\t\r\x0b\x0c",
    *map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)),
    *"\x1c\x1d\x1e\x1f",
)
#: Signs that end a word; a run of them is one pre-token of either vocabulary.
_SIGNS = ".,;:!?*$%&#|\")"


def default_path(name: str) -> str:
    """Where the tokenizer file ``name`` lies on this machine (every worker has the same package)."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def encoder(path: str, cut: str) -> Encoder:
    """The encoder of this worker process."""
    return Encoder(path, cut)


def _byte_letters() -> dict[int, str]:
    """The letter that a byte-level vocabulary writes for each byte: itself where it can be
    printed, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}


class Encoder:
    """``ids(texts)`` yields one uint32 array per text.

    ``cut`` says where chunks end: ``"blank"`` before each single blank (byte-level vocabularies,
    which keep white space inside pre-tokens), ``"space"`` at any white space (lower-casing
    vocabularies that drop it), ``"none"`` nowhere.  Specials of the vocabulary inside a text keep
    their own id, as the tokenizer does by itself.
    """

    def __init__(self, path: str, cut: str, kept: int = KEPT_CHUNKS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.cut, self.kept, self.letters = cut, kept, _byte_letters()
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.begins = array("I"), array("q", [0])
        self.flat_now = self.begins_now = np.zeros(0, np.int64)

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _safe(self, text: str) -> bool:
        """Whether the text may be cut."""
        if self.cut == "none" or any(s in text for s in self.specials):
            return False
        if any(s in text for s in (_UNUSUAL[:4] + _UNUSUAL[-4:] if text.isascii() else _UNUSUAL)):
            return False
        return self.cut == "space" or not ("  " in text or " \n" in text or "\n " in text)

    def _word(self, word: str, blank: bool) -> list[int]:
        """Ids of a word of letters only, which is one pre-token."""
        if self.cut == "space":
            if not word.isascii():
                if "Σ" in word:  # lower-cases by its place in the word in Python only
                    return self._whole(word)
                lower = unicodedata.normalize("NFC", word).lower()
                if not lower.isalpha():  # a letter may become a letter and a mark
                    return self._whole(word)
                word = lower
            word = word.lower()
        if blank:
            word = " " + word
        word = word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(word)]

    def _stays_letters(self, word: str) -> bool:
        """Whether the vocabulary's own form of the word is letters only: a mark that a letter leaves
        at the end would be one pre-token with the signs behind it."""
        if self.cut == "blank" or word.isascii():
            return True
        return "Σ" not in word and unicodedata.normalize("NFC", word).lower().isalpha()

    def _chunk(self, chunk: str, blank: bool) -> list[int]:
        """Ids of a chunk; ``blank`` says that a blank stands before it."""
        if "\n" in chunk and self.cut == "blank":
            first, _, rest = chunk.partition("\n")
            if not first or not rest or rest[0] == "\n":
                return self._whole(" " + chunk if blank else chunk)
            return [*self._known(first, blank), *self._known("\n", False), *self._known(rest, False)]
        word = chunk.rstrip(_SIGNS)
        if word.isalpha() and self._stays_letters(word):
            if len(word) == len(chunk):
                return self._word(word, blank)
            return [*self._known(word, blank), *self._known(chunk[len(word) :], False)]
        return self._whole(" " + chunk if blank else chunk)

    def _place(self, chunk: str, blank: bool) -> int:
        key = chunk if blank else "\n" + chunk  # chunks after a blank are the common ones
        place = self.places.get(key)
        if place is None:
            ids = self._chunk(chunk, blank) if chunk != "\n" else self._whole(chunk)
            place = self.places[key] = len(self.begins) - 1
            self.flat.extend(ids)
            self.begins.append(len(self.flat))
        return place

    def _known(self, chunk: str, blank: bool) -> array:
        place = self._place(chunk, blank)
        return self.flat[self.begins[place] : self.begins[place + 1]]

    def _arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the kept ids and their bounds, made anew when they have grown by a part."""
        if len(self.begins_now) != len(self.begins):
            self.flat_now = np.array(self.flat, dtype=np.uint32)
            self.begins_now = np.array(self.begins, dtype=np.int64)
        return self.flat_now, self.begins_now

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """All texts are looked up first, then their ids are taken from the kept ones at once."""
        if len(self.begins) > self.kept:
            self._forget()
        get, blank = self.places.get, self.cut == "blank"
        found: list = []
        for text in texts:
            if not self._safe(text):
                found.append(np.array(self._whole(text), dtype=np.uint32))
                continue
            if blank:
                first, *chunks = text.split(" ")
                places = [self._place(first, False)] if first else []
            else:
                chunks, places = text.split(), []
            rest = list(map(get, chunks))
            if None in rest:
                if blank:
                    rest = [self._place(c, True) if p is None else p for c, p in zip(chunks, rest)]
                else:
                    rest = [self._spaced(c) if p is None else p for c, p in zip(chunks, rest)]
            found.append(places + rest)
        flat, begins = self._arrays()
        for places in found:
            if isinstance(places, np.ndarray):
                yield places
                continue
            at = np.array(places, dtype=np.int64)
            begin = begins[at]
            size = begins[at + 1] - begin
            ends = np.cumsum(size)
            total = int(ends[-1]) if len(ends) else 0
            yield flat[np.repeat(begin - ends + size, size) + np.arange(total)]

    def _spaced(self, chunk: str) -> int:
        """Place of a chunk of a vocabulary that drops white space: no blank before it, but kept
        under the plain key."""
        place = self.places.get(chunk)
        if place is None:
            ids = self._chunk(chunk, False)
            place = self.places[chunk] = len(self.begins) - 1
            self.flat.extend(ids)
            self.begins.append(len(self.flat))
        return place
