"""Exact tokenisation with a word cache, for use inside Arrow tasks.

A byte-pair tokenizer first cuts a text into pre-tokens (a run of letters, a run of
punctuation, ...) and then merges inside each pre-token only.  A text may therefore be
cut at any pre-token border, and the ids of the parts, laid end to end, are the ids of
the text.  ``WordCache`` cuts at borders it can prove (single spaces between words, and
runs of plain Latin letters that end at a space, full stop or comma), remembers the ids
of what it has seen and asks the ``tokenizers`` library for the rest.  Texts in which the
cheap cut cannot be proved go to the library whole.

The caches are bounded (``MAX_CHUNKS``, ``MAX_WORDS`` entries); beyond that a word is
encoded anew each time, which costs time and never changes an id.
"""
from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

MAX_CHUNKS, MAX_WORDS = 400_000, 1_200_000


def _plain_letters(last: int = 0x24F) -> str:
    """Character class of the Latin letters up to ``last`` that stay one character when a tokenizer
    lower-cases or normalises them; one that expands (U+0130 gives a letter and a mark) may join its neighbours."""
    def one(c: str) -> bool:
        return len(c.lower()) == 1 and all(len(unicodedata.normalize(form, x)) == 1 for form in ("NFC", "NFKC") for x in (c, c.lower()))

    return "".join(c for c in map(chr, range(ord("A"), last + 1)) if unicodedata.category(c)[0] == "L" and c not in "ªº" and one(c))


LATIN = _plain_letters()
WORD_PARTS = {
    # pre-tokens take one leading space along
    True: re.compile(rf" ?[{LATIN}]+(?=[\s.,]|$)|[.,](?=\s|$)|\n(?=[{LATIN}])|\s*\S+|\s+$").findall,
    # white space is dropped
    False: re.compile(rf"[{LATIN}]+(?=[\s.,]|$)|[.,](?=\s|$)|\S+").findall,
}
PLAIN = {True: re.compile(rf" ?[{LATIN}]+").fullmatch, False: re.compile(rf"[{LATIN}]+").fullmatch}
#: White space (and signs once counted as such) other than space and line feed: a text that
#: holds one is cut by the slower pattern, and goes to the library whole if Python and the
#: tokenizer's regular expressions may disagree on it.
OTHER_SPACE = "\t\r\x0b\x0c"
ODD_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e" + "".join(map(chr, range(0x2000, 0x2010))) + "\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"


def has_any(text: str, signs: str) -> bool:
    return any(c in text for c in signs)


def double_space(text: str) -> bool:
    """White space next to white space: the cut at single spaces does not hold there."""
    return has_any(text, OTHER_SPACE) or "  " in text or "\n" in text and ("\n\n" in text or " \n" in text or "\n " in text)


class WordCache:
    """``encode(text)`` gives the ids as little-endian unsigned 16-bit bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True  # their strings in a text are ordinary text
        if self.lib.get_vocab_size() > 1 << 16:
            raise ValueError("ids over 65,535 do not fit this cache")
        self.spaced = self.lib.encode(" a").tokens != self.lib.encode("a").tokens
        self.parts, self.plain = WORD_PARTS[self.spaced], PLAIN[self.spaced]
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """Ids of unseen parts; the plain words go to the library as one text."""
        got: dict[str, bytes] = {}
        plain = [p for p in parts if self.plain(p)]
        if self.spaced:
            plain = [p for p in plain if p[0] == " "]
        if len(plain) > 1:
            enc = self.lib.encode(("" if self.spaced else " ").join(plain), add_special_tokens=False)
            ids, of = np.array(enc.ids, "<u2").tobytes(), np.array(enc.word_ids)
            ends = [0, *(2 * (np.flatnonzero(np.diff(of)) + 1)).tolist(), len(ids)]
            if len(ends) == len(plain) + 1:  # one pre-token a word, as the pattern promises
                got = {p: ids[a:b] for p, a, b in zip(plain, ends, ends[1:])}
        rest = [p for p in parts if p not in got]
        got.update(zip(rest, self._ids(rest)))
        return got

    def _by_parts(self, text: str) -> bytes:
        parts, words = self.parts(text), self.words
        try:
            return b"".join([words[p] for p in parts])
        except KeyError:
            pass
        new = self._learn(set(parts).difference(words))
        if len(words) < MAX_WORDS:
            words.update(new)
            return b"".join([words[p] for p in parts])
        return b"".join([words.get(p) or new.get(p, b"") for p in parts])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if has_any(text, ODD_SPACE):
            return self._ids([text])[0]
        if self.spaced and (double_space(text) or text[-1].isspace()):
            return self._by_parts(text)
        first, *rest = text.split(" ")
        chunks, lead = self.chunks, " " if self.spaced else ""
        new = set(rest).difference(chunks)
        if new:
            cut = {c: self.parts(lead + c) for c in new}
            words = self.words
            unseen = {p for parts in cut.values() for p in parts if p not in words}
            got = self._learn(unseen) if unseen else {}
            if len(words) < MAX_WORDS:
                words.update(got)
            made = {c: b"".join([words[p] if p in words else got[p] for p in parts]) for c, parts in cut.items()}
            if len(chunks) < MAX_CHUNKS:
                chunks.update(made)
            else:
                return self._by_parts(first) + b"".join([chunks[c] if c in chunks else made[c] for c in rest])
        return self._by_parts(first) + b"".join([chunks[c] for c in rest])


_caches: dict[str, WordCache] = {}


def word_cache(path: str) -> WordCache:
    """The Python worker's cache for one vocabulary file; it outlives the task."""
    if path not in _caches:
        _caches[path] = WordCache(path)
    return _caches[path]
