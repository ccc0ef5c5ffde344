"""Latin readings of Devanagari, accent folding and sound keys."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa

from kinlink.llm.looks import latin_reading, script, visual_fold

# The Devanagari letters in their order (Unicode block), with their usual Latin readings.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l v sh sh s h".split(), strict=True))
NUKTA = {"क": "q", "ख": "kh", "ग": "g", "ज": "z", "ड": "r", "ढ": "rh", "फ": "f", "य": "y"}
VOWELS = dict(zip("अआइईउऊऋएऐओऔऑऍ", "a a i i u u ri e ai o au o e".split(), strict=True))
SIGNS = dict(zip("ािीुूृेैोौॉॅ", "a i i u u ri e ai o au o e".split(), strict=True))
_DEVANAGARI = re.compile("[ऀ-ॿ]+")


@lru_cache(maxsize=1 << 16)
def _word(w: str) -> str:
    w = unicodedata.normalize("NFD", w)
    out: list[str] = []
    i = 0
    while i < len(w):
        c = w[i]
        if c in CONSONANTS:
            base = CONSONANTS[c]
            if i + 1 < len(w) and w[i + 1] == "़":
                base, i = NUKTA.get(c, base), i + 1
            out.append(base)
            follow = w[i + 1] if i + 1 < len(w) else ""
            if follow in SIGNS:
                out.append(SIGNS[follow])
                i += 1
            elif follow == "्":
                i += 1
            elif follow:  # the inherent vowel, silent at the end of a word
                out.append("a")
        elif c in VOWELS:
            out.append(VOWELS[c])
        elif c in "ंँ":
            out.append("n")
        elif "०" <= c <= "९":
            out.append(chr(ord(c) - 0x966 + 48))
        i += 1
    return "".join(out)


def devanagari_to_latin(text: str) -> str:
    return text if text.isascii() else _DEVANAGARI.sub(lambda m: _word(m.group()), text)


_EXTRA = str.maketrans({"ß": "ss", "œ": "oe", "æ": "ae", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "’": "'", "‘": "'"})


def ascii_lower(text: str) -> str:
    """Lower case without accents; letters of other scripts stay."""
    text = text.lower()
    if text.isascii():
        return text
    return "".join([c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)]).translate(_EXTRA)


def strings(column: pa.Array) -> list:
    """The values of a column of strings or booleans, by way of numpy, which is some times faster than to_pylist."""
    return column.to_numpy(zero_copy_only=False).tolist()


class _Plain(dict):
    """What plain() makes of a character on its own; letters of other scripts than Latin stay as they are."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        own = "" if unicodedata.combining(ch) else ch if script(ch) not in ("", "latin") else " " if ch.isspace() else ascii_lower(visual_fold(ch))
        self[code] = own
        return own


_PLAIN = _Plain()


def plain(raw: str) -> str:
    """Lower case in Latin letters, where that can be had, without accents, look-alikes and odd characters."""
    if raw.isascii():
        return " ".join(raw.lower().split()) if raw.isprintable() else visual_fold(raw).lower()
    text = raw.translate(_PLAIN)
    if text.isascii():  # no other script: no letter depends on those around it
        return " ".join(text.split())
    return ascii_lower(devanagari_to_latin(latin_reading(visual_fold(raw))))


# Letters exchanged in writing down what is heard, replaced in this order.
SOUNDS = (("ee", "i"), ("oo", "u"), ("ph", "f"), ("w", "v"), ("ck", "k"), ("q", "k"), ("ch", "kh"), ("kh", "k"), ("c", "k"), ("y", "i"), ("z", "s"))
_DOUBLED = re.compile(r"(.)\1+")
_DOUBLED_CONSONANT = re.compile(r"([^aeiou])\1+")
_NO_VOWELS = str.maketrans("", "", "aeiou")


@lru_cache(maxsize=1 << 17)
def sound(word: str) -> str:
    """One spelling for letters that are exchanged in writing down what is heard; doubled consonants count once.
    Doubled vowels stay: where they come from a lost consonant, that is one edit."""
    for a, b in SOUNDS:
        word = word.replace(a, b)
    return _DOUBLED_CONSONANT.sub(r"\1", word) if _DOUBLED_CONSONANT.search(word) else word


@lru_cache(maxsize=1 << 17)
def skeleton(word: str) -> str:
    """The consonants of the sound key."""
    s = sound(word)
    bones = s.translate(_NO_VOWELS)
    return (_DOUBLED.sub(r"\1", bones) if _DOUBLED.search(bones) else bones) or s[:1]
