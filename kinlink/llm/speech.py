"""Speech in subtitle files: cues without times, numbers, markup, speakers, sound descriptions, adverts and credits."""

from __future__ import annotations

import html
import re

_TIME = re.compile(r"(?m)^[^\n]*\d[ \t]*-+>[ \t]*\d[^\n]*|\{\d+\}\{\d+\}")
_TAG = re.compile(r"<[^<>\n]{0,80}>|\{[^{}\n]{0,80}\}|<(?:font|i|b|u|/)[^<>]{0,80}>", re.I)
_SOUND = re.compile(r"\[[^\[\]]*\]|\([^()]*\)|♪[^♪]*♪?|♫[^♫]*♫?|（[^（）]*）|^[ \t]*#[^#\n]*#?[ \t]*$", re.M)
_SPEAKER = re.compile(r"(?m)^[ \t]*[-–—]*[ \t]*(?:[^\W\d_a-zа-яß-öø-ÿ][^\n:,.!?a-zа-яß-öø-ÿ]{1,30}|[A-ZÀ-Þ][\w'-]{1,24}):(?=\s)")
_DASH = re.compile(r"(?m)^[ \t]*[-–—•>]+[ \t]*")
_ADVERT = re.compile(
    r"\b[\w-]+\.(?:example|com|net|org|tv|info|me|io)\b|\bwww\.|https?:|\bvip member\b|\badvertise your product\b|\bsync(?:ed|hroni[sz]ed)\b.{0,30}\b(?:by|correct)|\bsub(?:title|bed|s)s?\b.{0,20}\b(?:by|from)\b|\bripped by\b|\bencoded by\b|\bcaption(?:s|ed|ing)\b.{0,20}\bby\b|\btradu\w*\s+(?:por|par|da|di|by)\b|\bsubt[ií]tulos\b.{0,20}\b(?:por|de)\b|\bsous-?titr\w*\b.{0,20}\b(?:par|de)\b|\blegendas?\b\s*(?::|por|de|by)|\buntertitel\b\s*(?::|von|by)|\bvertaling\b|\bondertitel\w*\b\s*(?::|door|van)|\bsottotitoli\b\s*(?::|di|da|a cura)|\b(?:субтитры|перевод)\b\s*(?::|от|by)|\btranslat(?:ed|ion)\b.{0,12}\b(?:by|:)|\bw w w\b|\. ?e x a m p l e|\b(?:sous-?titres?|subtitles|subtítulos|sottotitoli|untertitel|ondertiteling|legendas) ?:",
    re.I | re.S,
)
_HINT = frozenset("ÃÂÐÑâ")
_BYTE = {bytes([b]).decode("cp1252"): b for b in range(128, 256) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)} | {chr(b): b for b in range(256)}


def repair_encoding(text: str) -> str:
    """Text that was read in a single-byte encoding although it was UTF-8, read rightly; once or more often. Other text
    stays as it is."""
    for _ in range(3):
        if not _HINT & set(text):
            return text
        try:
            text = bytes([_BYTE[c] for c in text]).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            return text
    return text


def _mend(body: str) -> str:
    whole = repair_encoding(body)
    return whole if whole != body or "\n" not in body else "\n".join(map(repair_encoding, body.split("\n")))


_ADVERT_HINTS = ("www", "http", ".example", ".com", ".net", ".org", ".tv", ".info", ".me", ".io", "w w w", "e x a m", "vip", "advert", "sync", "subtit", "subs", "subbed", "rip", "encod", "caption", "tradu", "subt\u00ed", "titr", "legend", "untertit", "vertaling", "ondertit", "sottotit", "\u0441\u0443\u0431\u0442", "\u043f\u0435\u0440\u0435\u0432", "translat")
_CYRILLIC_AS_LATIN = re.compile("[\u00c0-\u00ff\u00a8\u00b8]")
_LETTER = re.compile(r"[^\W\d_]")


def repair_cyrillic(text: str) -> str:
    """Russian in a single-byte encoding that was read as Western European: most letters carry accents then."""
    odd = len(_CYRILLIC_AS_LATIN.findall(text))
    if odd * 2 < len(_LETTER.findall(text)) or odd < 8:
        return text
    best = text
    score = 0
    for code in ("cp1251", "koi8-r"):
        try:
            t = bytes([_BYTE[c] for c in text]).decode(code)
        except (KeyError, UnicodeDecodeError):
            continue
        n = sum("\u0430" <= c <= "\u044f" for c in t)
        if n > score:
            best, score = t, n
    return best


def spoken_cues(text: str | None) -> list[str]:
    """The speech of each cue, in the order of the file, its lines kept apart; cues without speech are left out. Text
    without any times is taken as one cue a paragraph. Null and empty texts hold none."""
    if not text:
        return []
    if "\r" in text or "\u2028" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\u2028", "\n")
    odd = not text.isascii()
    if odd and len(_CYRILLIC_AS_LATIN.findall(text)) * 4 > len(text):
        text = repair_cyrillic(text)
    garbled = odd and not _HINT.isdisjoint(text)
    tags = "<" in text or "{" in text
    sounds = "[" in text or "(" in text or "#" in text or odd and ("\u266a" in text or "\u266b" in text or "\uff08" in text)
    low = text.lower()
    adverts = any(h in low for h in _ADVERT_HINTS)
    entities = "&" in text
    bodies = _TIME.split(text)
    if len(bodies) > 1:
        del bodies[0]
    else:
        bodies = re.split(r"\n\s*\n", text)
    out = []
    for body in bodies:
        body = body.strip("\n \t\ufeff")
        if body[-1:].isdigit():
            head, _, last = body.rpartition("\n")
            if last.strip("\ufeff \t").isdigit():
                body = head.rstrip()
        if not body:
            continue
        if garbled and not _HINT.isdisjoint(body):
            body = _mend(body)
        if tags and ("<" in body or "{" in body):
            body = _TAG.sub("", body)
        if sounds:
            body = _SOUND.sub(" ", body)
        if adverts and _ADVERT.search(body.replace("\n", " ")):
            continue
        if ":" in body:
            body = _SPEAKER.sub(" ", body)
        if "-" in body or "\u2013" in body or ">" in body:
            body = _DASH.sub(" ", body)
        if entities and "&" in body:
            body = html.unescape(body)
        body = body.strip()
        if body and (body[0].isalnum() or any(c.isalnum() for c in body)):
            out.append(body)
    return out
