"""Whole texts through a public tokenizer, each different word only once a worker.

Both tokenizers end a pre-token before a space that is followed by a letter, so a text's tokens
are those of its words. Words are looked up in a bounded cache; plain letters go straight to the
library's model, and everything else through its whole pipeline. Texts in which words may not
stand alone (runs of white space, special strings) are encoded in one piece.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

CACHE = 400_000    # different words a worker keeps

# Latin letters in composed, lower-case form: one letter run, its own normal form.
_PLAIN_LOWER = re.compile(r"[a-zß-öø-ÿ]+")
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")
# What the tokenizer parts a word into: runs of such letters, single digits, runs of ASCII signs (quotes may be part of a contraction).
_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!-&(-/:-@\[-`{-~]+")
# White space by which words do not simply stand apart: runs, ends of the text, other kinds.
_LOOSE = re.compile(r"[ \n](?!\S)|(?<!\S)[ \n]|[^\S \n]")
_PAIRS = ("  ", "\n\n", " \n", "\n ")
_LATIN = bytes([10, *range(32, 127), *range(161, 256)])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(path: str):
    """The tokenizer of a file, once a worker process; single-threaded, as Spark runs the tasks."""
    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def byte_alphabet() -> list[str]:
    """The printable character that byte-level models write for each byte."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


_ALPHABET = byte_alphabet()


def loose(text: str) -> bool:
    """Whether the text's words may not stand alone for a byte-level tokenizer."""
    try:
        if not text.encode("latin-1").translate(None, _LATIN):
            return text[0] in " \n" or text[-1] in " \n" or any([p in text for p in _PAIRS])
    except UnicodeEncodeError:
        pass
    return _LOOSE.search(text) is not None


def spelled(text: str) -> str:
    if text.isascii():
        return text
    return "".join([_ALPHABET[b] for b in text.encode()])


def _plain_lower(word: str) -> bool:
    if word.isascii():         # far cheaper than the pattern
        return word.isalpha() and word.islower()
    return _PLAIN_LOWER.fullmatch(word) is not None


class _Cache(dict):
    """Half of the words kept are those met since the last turn; of the half before, only what is met again stays."""

    def __init__(self, fresh):
        self.fresh, self.before = fresh, {}

    def __missing__(self, word):
        if len(self) >= CACHE // 2:
            self.before = dict(self)
            self.clear()
        value = self.before.get(word)
        if value is None:
            value = self.fresh(word)
        self[word] = value
        return value


class ByteCounter:
    """Token counts of a byte-level tokenizer."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.later = _Cache(self._later)

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _later(self, word: str) -> int:
        """Tokens of a word with the space or line break before it."""
        if word[:1] == "\n":       # a line break stands alone before a visible character
            return 1 + self._first(word[1:])
        if word[-1] in ",." and _PLAIN.fullmatch(word, 0, len(word) - 1):
            return 1 + self.later[word[:-1]]
        if _PLAIN.fullmatch(word):
            return len(self.model.tokenize("Ġ" + spelled(word)))
        return self.whole(" " + word)

    def _first(self, word: str) -> int:
        if _PLAIN.fullmatch(word):
            return len(self.model.tokenize(spelled(word)))
        return self.whole(word)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if loose(text) or any([s in text for s in self.special]):
            return self.whole(text)
        parts = text.replace("\n", " \n").split(" ")
        return self._first(parts[0]) + sum(map(self.later.__getitem__, parts[1:]))


class WordEncoder:
    """Ids of a tokenizer that drops white space and marks word ends, as unsigned 16-bit bytes.

    Ids above 65535 are refused: such a vocabulary needs another width.
    """

    def __init__(self, path: str):
        self.tokenizer = load(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("more ids than 16 bits hold")
        self.model = self.tokenizer.model
        self.words = _Cache(self._word)

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _word(self, word: str) -> bytes:
        if _plain_lower(word):
            return array("H", [t.id for t in self.model.tokenize(spelled(word))]).tobytes()
        if word[-1] in ",." and _plain_lower(word[:-1]):
            return self.words[word[:-1]] + self.words[word[-1]]
        pieces = _PIECES.findall(word)
        if len(pieces) > 1 and sum(map(len, pieces)) == len(word):
            return b"".join(map(self.words.__getitem__, pieces))
        return self.whole(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any([m in text for m in _MARKS]):
            return self.whole(text)
        return b"".join(map(self.words.__getitem__, _apart(_lower(text)).split()))


# str.split() parts words here, the tokenizer does not; and special strings.
_MARKS = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")


# Latin-1 letters in lower case, digits and line breaks; commas and full stops; the space; all others, which may be part of a run of signs.
_KINDS = bytes(32 if b == 32 else 44 if b in b",." else 97 if b == 10 or chr(b).isascii() and chr(b).isalnum() or _PLAIN_LOWER.fullmatch(chr(b)) else 33
               for b in range(256))


def _apart(text: str) -> str:
    """The text with commas and full stops before spaces as words of their own, unless signs run on into them.

    A letter or digit and a sign are never in one piece of the tokenizer, so the ids stay; of words only half as many differ.
    """
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return text
    if b"!, " in kinds or b",, " in kinds:
        return text
    return text.replace(", ", " , ").replace(". ", " . ")


def _lower(text: str) -> str:
    """Letters that lower-case one by one in any context, as the tokenizer does it: Latin-1, else ASCII."""
    try:
        text.encode("latin-1")
        return text.lower()
    except UnicodeEncodeError:
        return text.encode().lower().decode()


@lru_cache(maxsize=4)
def byte_counter(path: str) -> ByteCounter:
    return ByteCounter(path)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
