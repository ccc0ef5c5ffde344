"""What a string looks like: compatibility forms, invisible characters, look-alike letters, scripts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

# Letters of other scripts that are drawn like a Latin letter (Unicode confusables, public).
CYRILLIC = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "ү": "y", "ѵ": "v", "г": "r", "ь": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V", "Ӏ": "I", "Ԍ": "G",
}
GREEK = {
    "α": "a", "ο": "o", "ν": "v", "υ": "u", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "χ": "x", "γ": "y", "η": "n", "ω": "w", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
}
ARMENIAN = {"օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "յ": "j", "ա": "w", "ք": "p", "լ": "l", "Տ": "S", "Օ": "O", "Ս": "U", "Լ": "L"}
TO_LATIN = CYRILLIC | GREEK | ARMENIAN
FROM_LATIN = {"cyrillic": {v: k for k, v in reversed(CYRILLIC.items())}, "greek": {v: k for k, v in reversed(GREEK.items())}, "armenian": {v: k for k, v in reversed(ARMENIAN.items())}}
_TO_LATIN = str.maketrans(TO_LATIN)

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿\x00-\x08\x0e-\x1f\x7f-\x84\x86-\x9f]")
_BLANK = re.compile(r"[\s   -     　]+")
_SAME_FORM = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<compat>", "<initial>", "<medial>", "<final>", "<isolated>"}
PIECE = re.compile(r"[^\W_]+|[\W_]+")


@lru_cache(maxsize=1 << 16)
def _compat(ch: str) -> str:
    """The ordinary form of a full-width, ligature or presentation form; superscripts, fractions and circled signs look
    different and stay."""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in _SAME_FORM and rest and not rest.startswith("0020 "):
        return "".join(_compat(chr(int(x, 16))) for x in rest.split())
    return {"‐": "-", "−": "-"}.get(ch, ch)


def visual_fold(text: str) -> str:
    """One spelling of the characters of a text without changing its letters: compatibility forms replaced, invisible
    characters removed, every run of blanks one space, canonically composed. Case and accents stay."""
    if text.isascii():
        return " ".join((text if text.isprintable() else _INVISIBLE.sub("", text)).split())
    text = "".join([c if c < "\x80" else _compat(c) for c in text])
    text = _BLANK.sub(" ", _INVISIBLE.sub("", text)).strip()
    return unicodedata.normalize("NFC", text)


@lru_cache(maxsize=1 << 16)
def script(ch: str) -> str:
    """latin, cyrillic, greek, armenian, devanagari or other for a letter or mark; empty for all else."""
    if ch.isascii():
        return "latin" if ch.isalpha() else ""
    if not unicodedata.category(ch).startswith(("L", "M")):
        return ""
    first = unicodedata.name(ch, "").partition(" ")[0].lower()
    return first if first in ("latin", "cyrillic", "greek", "armenian", "devanagari") else "" if first == "combining" else "other"


def dominant(text: str) -> str:
    """The script that most of the text can be spelled in: the fewest letters are left that have no look-alike there; then
    the script of most letters, then Latin."""
    n: dict[str, int] = {}
    letters = [(ch, s) for ch in text if (s := script(ch))]
    for _, s in letters:
        n[s] = n.get(s, 0) + 1
    if len(n) < 2:
        return next(iter(n), "")
    return min(n, key=lambda t: (sum(s != t and not _twin(ch, s, t) for ch, s in letters), -n[t], t != "latin"))


def _twin(ch: str, own: str, target: str) -> str | None:
    """The letter of the target script that looks like a letter of its own script."""
    plain = TO_LATIN.get(ch) or (ch if own == "latin" else None)
    return plain if target == "latin" else FROM_LATIN.get(target, {}).get(plain or "")


def _into(token: str, target: str) -> str | None:
    out = []
    for ch in token:
        s = script(ch)
        if s and s != target:
            ch = _twin(ch, s, target)
            if not ch:
                return None
        out.append(ch)
    return "".join(out)


def repairs(token: str, around: str) -> list[str]:
    """Spellings of a token in one script, the likeliest first: that of its dominant script, then that of the text around
    it. Empty if nothing is to be repaired: the token is in one script which is that of the text, or a letter has no
    look-alike. The caller accepts a spelling only if the corpus vocabulary holds it."""
    scripts = {s for s in map(script, token) if s}
    if len(scripts) <= 1 and (not scripts or scripts == {around}):
        return []
    targets = dict.fromkeys([dominant(token), around, "latin"]) if len(scripts) > 1 else {around: None}
    return [x for x in dict.fromkeys(_into(token, t) for t in targets if t) if x and x != token]


def latin_reading(text: str) -> str:
    """All look-alikes of mixed-script tokens as Latin letters, without a vocabulary: a search key, not a repair."""
    if text.isascii():
        return text
    return "".join([p.translate(_TO_LATIN) if not p.isascii() and len({s for s in map(script, p) if s}) > 1 else p for p in PIECE.findall(text)])
