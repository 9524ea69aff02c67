"""Token ids by the tokenizers library, with each distinct word encoded once."""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from codecs import charmap_decode

import numpy as np

from .common import release_memory

# Fixed value: the splitting rule that byte-level BPE files of this family apply before merging.
PRETOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A space inside or at the end of white space: only there can a word's first space belong to the text before.
_INNER_SPACE = re.compile(r"\s (?!\S)")
#: The same where no two spaces meet: only what is rare in a text is looked at.
_INNER_SPACE_AFTER = re.compile(r"[^\S ] (?!\S)")
#: A line feed that other white space, or more than one line feed, stands beside: only there is it not a word of its own.
_ODD_FEED = re.compile(r"\n(?:(?<=[^\S\n]\n)|[^\S\n ]|\n(?:\s|\Z))")
#: Texts of other scripts go through the library whole, so that its own tables of letters decide.
_PLAIN = re.compile(r"[\x00-ɏ‐-‧]*")


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Kept(dict):
    """Values made when first asked for, in two generations: once the younger is full it becomes the elder, and what is not asked for again goes."""

    def __init__(self, make, most: int, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest, self.elder = make, most, longest, {}

    def __missing__(self, key: str) -> bytes:
        value = self.elder.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.elder = dict(self)
            self.clear()
        self[key] = value
        return value


class WordTokenizer:
    """Encodes whole texts to little-endian ids, exactly as the library's encode without special tokens.

    A space before a visible character always starts a new word under the splitting rule, so ids of
    the words between spaces can be kept and joined. A line feed alone is a word too, so texts are cut
    there as well, and what follows it is kept by its name with the line feed. Two tables of at most ``2 * max_words`` words
    each are kept (words after a space, and the parts of those that are not letters alone), which
    changes memory and time but no result. Files of another kind, and texts
    that hold an added token or odd white space, are encoded by the library as a whole.
    """

    def __init__(self, path: str, max_words: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        size = self.whole.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
        simple = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and model.get("type") == "BPE" and not model.get("byte_fallback") and not model.get("dropout")
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.words: _Kept | None = None
        if simple and sys.byteorder == "little":
            self.model = self.whole.model  # shared with the whole tokenizer, not a second one
            letters = _byte_letters()
            self.letters = "".join(letters[b] for b in range(256))
            self.space = self.letters[32]
            self.packed = [i.to_bytes(self.dtype.itemsize, "little") for i in range(size)]
            self.split = regex.compile(PRETOKENS).findall
            self.short = _Kept(self._token, max_words)
            self.words = _Kept(self._word, max_words)

    def _library(self, text: str) -> bytes:
        return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _ids(self, shown: str) -> bytes:
        packed = self.packed
        return b"".join([packed[t.id] for t in self.model.tokenize(shown)])

    def _token(self, word: str) -> bytes:
        if word.isascii() and word[1:].isalnum():
            return self._ids(self.space + word[1:] if word[0] == " " else word)
        return self._ids(charmap_decode(word.encode(), "strict", self.letters)[0])

    def _word(self, word: str) -> bytes:
        """Ids of a space and the word after it; of a word that begins with a line feed, ids of the line feed and what follows, without a space."""
        if word[:1] == "\n":
            after = word[1:]
            if (after.isascii() or _PLAIN.fullmatch(after)) and after.isalpha():
                return self.short["\n"] + self.short[after]
            return self.short["\n"] + (self._piece(after) if after else b"")
        if (ascii := word.isascii()) or _PLAIN.fullmatch(word):
            # A space and letters are one word of the splitting rule, and a stop or comma after them another.
            if word.isalpha():
                return self._ids(self.space + word) if ascii else self._token(" " + word)
            if word[-1:] in (".", ",") and word[:-1].isalpha():
                return self.words[word[:-1]] + self.short[word[-1]]
        return self._piece(" " + word)

    def _piece(self, piece: str) -> bytes:
        if not (piece.isascii() or _PLAIN.fullmatch(piece)):
            return self._library(piece)
        return b"".join(map(self.short.__getitem__, self.split(piece)))

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        inner = _INNER_SPACE if "  " in text else _INNER_SPACE_AFTER
        if self.words is None or inner.search(text) or any(t in text for t in self.added):
            return self._library(text)
        if "\n" in text:
            if _ODD_FEED.search(text):
                first, *rest = text.split(" ")
                return (self._piece(first) if first else b"") + b"".join([self._piece(" " + w) if w[:1] == "\n" else self.words[w] for w in rest])
            text = text.replace("\n", " \n")
        first, *rest = text.split(" ")
        return (self._piece(first) if first else b"") + b"".join(map(self.words.__getitem__, rest))

    def ids32(self, text: str | None, end_id: int | None = None) -> np.ndarray:
        ids = np.frombuffer(self.encode(text), dtype=self.dtype).astype("<u4")
        return ids if end_id is None else np.append(ids, np.uint32(end_id))


#: Words kept at most in each of a tokenizer's tables and generations; up to four times as many in all.
MAX_WORDS = 500_000
_made: dict[tuple[str, int], WordTokenizer] = {}


def tokenizer(path: str, max_words: int = MAX_WORDS) -> WordTokenizer:
    """One tokenizer a worker process, of the file and size asked for last; its words stay from task to task."""
    if (path, max_words) not in _made:
        _made.clear()
        release_memory()
        _made[path, max_words] = WordTokenizer(path, max_words)
    return _made[path, max_words]


def crc32_u32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
