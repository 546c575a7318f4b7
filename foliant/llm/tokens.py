"""Token ids of whole texts, by the tokenizers library, with a bounded cache of words.

BPE never merges across the pieces of the pre-tokenizer, so a text's ids are the ids of its words put together
wherever a word is certain to end a piece: at a single white space between others. A word seen before costs one
dictionary look-up; an unseen one is cut into the pre-tokenizer's pieces, and unseen pieces go to the library's BPE
model. Words with characters beyond Latin letters and common punctuation go to the library's whole encode() instead,
so that no difference between Unicode tables can matter, and so do texts with runs of white space. Texts that hold an
added token (<|endoftext|>) as text go there whole, as the library finds those before all else.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from array import array

#: White space as the tokenizers' own patterns see it: Python's \s also has U+001C to U+001F.
_CHUNK = re.compile(r" ?[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+(?![\S\x1c-\x1f])|[^\S\x1c-\x1f]+")
_PLAIN = re.compile(" ?[\x21-\x7e¡-ɏ‐-‧]*").fullmatch
_SPACE = re.compile(r"(?!^ )\s").search
#: Marks that are a piece of their own at a word's end.
_MARKS = frozenset(".,;:!?")
#: Entries of each generation of each cache; the older of two goes when the younger is full.
CACHE_ENTRIES = 400_000


def _latin(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in (*range(0x21, 0x7F), *range(0xA1, 0x250)) if unicodedata.category(chr(c))[0] == kind)


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes for U+0100 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(rest)) for b in range(256)}


_LETTERS = _byte_letters()


class Cache(dict):
    """key -> make(key), in two generations: what is used again outlives what is not."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        value = self.older.pop(key, None)
        if value is None:
            value = self.make(key)
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Odd(Exception):
    """White space that may not be cut at."""


class Encoder:
    """encode() gives a whole text's ids as little-endian unsigned 32-bit integers, as the library has them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        # of normalized ones the case may be folded
        told = [rf"(?i:{re.escape(t.content)})" if t.normalized else re.escape(t.content) for t in added]
        self.added = re.compile("|".join(told)).search if told else None
        self.vocab = self.tokenizer.get_vocab_size()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"]
        parts = pre.get("pretokenizers", [])
        has = lambda d, **want: all(d.get(k) == v for k, v in want.items())
        letters, numbers = _latin("L"), _latin("N")
        if spec.get("normalizer") is None and has(pre, type="ByteLevel", add_prefix_space=False, use_regex=True):
            self.cut = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{numbers}]+| ?[^\s{letters}{numbers}]+").findall
            self.normal, self._encode = None, self._spaced
            letters_alone = lambda w: w.isascii() and w.isalpha()
            self.first = Cache(lambda w: self._ids(w) if letters_alone(w) else self._word(w))
            self.rest = Cache(lambda w: self._ids(f"\u0120{w}") if letters_alone(w) else self._word(f" {w}"))
            self.newline = self._whole("\n")
        elif len(parts) == 2 and has(parts[0], type="Split", behavior="Removed", invert=True) and has(parts[1], type="ByteLevel", add_prefix_space=False, use_regex=False):
            pattern = parts[0]["pattern"]["Regex"].replace("\\p{L}", letters).replace("\\p{N}", numbers)
            self.cut = re.compile(pattern).findall
            # of plain words (_PLAIN) NFC changes none, and the usual normalizer leaves only their case to fold
            steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (spec.get("normalizer") or {}).get("normalizers", [])]
            usual = [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            self.normal, self._encode = str.lower if steps == usual else self.tokenizer.normalizer.normalize_str, self._unspaced
            folds = self.normal is str.lower
            self.first = Cache(lambda w: self._ids(w.lower().decode()) if folds and w.isalpha() else self._word(w.decode()))
        else:
            self._encode = self._whole
        self.pieces = Cache(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        return self._ids(piece.replace(" ", "\u0120") if piece.isascii() else piece.encode().decode("latin-1").translate(_LETTERS))

    def _ids(self, known: str) -> bytes:
        """Of a piece in the byte-level alphabet."""
        got = self.model.tokenize(known)
        return array("I", [t.id for t in got] if len(got) > 1 else (got[0].id,)).tobytes()

    def _word(self, word: str) -> bytes:
        if not _PLAIN(word):
            if self.normal is None and _SPACE(word):
                raise _Odd
            return self._whole(word)
        key, bare = word, word.removeprefix(" ")
        if self.normal:
            word = self.normal(word)
        elif not bare:
            raise _Odd
        if word.removeprefix(" ").isalpha():
            return self._piece(word)
        if word[-1] in _MARKS and word[:-1].removeprefix(" ").isalpha():  # the word itself is in use, too
            known = self.first if key == bare else self.rest
            return known[bare[:-1].encode() if self.normal else bare[:-1]] + self.pieces[word[-1]]
        return b"".join([self.pieces[p] for p in self.cut(word)])

    def _spaced(self, text: str) -> bytes:
        """For pieces that begin with the space before them."""
        first, rest, out = self.first, self.rest, []
        try:
            for line in text.split("\n"):
                words = line.split(" ")
                out.append(first[words[0]] + b"".join([rest[w] for w in words[1:]]))
        except _Odd:
            keep = self._whole if len(text) < 200 else self._chunks
            return keep(text)
        return self.newline.join(out)

    def _chunks(self, text: str) -> bytes:
        """The same for texts with runs of white space."""
        out = []
        for chunk in _CHUNK.findall(text):
            bare = chunk.lstrip(" ")
            known = len(chunk) - len(bare) <= 1 and bare and not bare.isspace()
            out.append((self.rest if chunk[0] == " " else self.first)[bare] if known else self._whole(chunk))
        return b"".join(out)

    def _unspaced(self, text: str) -> bytes:
        """For patterns that leave white space out."""
        return b"".join(map(self.first.__getitem__, text.encode().split()))

    def encode(self, text: str | None) -> bytes:
        """None for a null or empty text."""
        if not text:
            return b""
        return self._whole(text) if self.added and self.added(text) else self._encode(text)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The library's own ids, by one encoder for each Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
