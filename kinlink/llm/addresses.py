"""Reading one-line postal addresses: house number, postcode, street, areas. Units, floors, wings and landmarks say nothing
about the location and are left out."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

from kinlink.llm.translit import plain, sound

# Words for kinds of streets and how they are shortened.
STREETS = dict(
    x.split(":")
    for x in "street:street st:street str:street road:road rd:road avenue:avenue ave:avenue av:avenue boulevard:boulevard blvd:boulevard boul:boulevard bd:boulevard bld:boulevard highway:highway hwy:highway lane:lane ln:lane gali:lane drive:drive dr:drive drv:drive court:court ct:court crt:court parkway:parkway pkwy:parkway pky:parkway terrace:terrace terr:terrace ter:terrace tce:terrace place:place pl:place square:square sq:square circle:circle cir:circle way:way trail:trail trl:trail marg:marg mg:marg mrg:marg chowk:chowk chk:chowk colony:colony col:colony clny:colony nagar:nagar ngr:nagar nagr:nagar nager:nagar industrialarea:industrialarea ia:industrialarea rue:rue route:route rte:route chemin:chemin che:chemin chem:chemin ch:chemin impasse:impasse imp:impasse allee:allee all:allee quai:quai qu:quai cours:cours passage:passage pass:passage".split()
)
_KINDS = frozenset(STREETS)
FRONT = frozenset("rue route chemin impasse allee quai cours passage".split())
EITHER = frozenset("avenue boulevard place".split())
COMPASS = {"n": "n", "north": "n", "s": "s", "south": "s", "e": "e", "east": "e", "w": "w", "west": "w", "no": "n", "so": "s"}
_PLACES = "cinema|tank|dairy|office|stand|tower|temple|school|hospital|market|station|bank|park|mall|church|mosque|college|bridge|talkies|theatre|mandir|masjid|gate|hotel|petrol pump|police"
_LANDMARK = re.compile(rf"\b(?:near|nr|opp|opposite|behind|beside|next to|adjacent to|adj|facing|in front of)\b\.?\s+(?:(?:[^\W\d]+\s+){{0,3}}?(?:{_PLACES})\b|[^,;]*)")
_ORDINAL = r"(?:\d{1,2}\s?(?:st|nd|rd|th)?|first|second|third|fourth|fifth|ground|gr|upper|lower|top|i{1,3}|iv|vi{0,3})"
_FLOOR = re.compile(rf"\b{_ORDINAL}\s*(?:floor|flr|fl|etage)\b\.?")
_WING = re.compile(r"\s*/\s*[a-z]\s*-?\s*wing\b|\b[a-z]\s+wing\b|\bwing\s+[a-z]\b")
_UNIT = re.compile(r"\b(?:suite|ste|unit|apartment|apt|appt|appartement|flat|room|rm|bldg|building|batiment|bat|escalier|esc|floor|flr|fl|etage|block|blk|tower)\b\.?\s*#?\s*(?:no\b\.?\s*)?(?:\d+[a-z]?|[a-z])\b")
_CEDEX = re.compile(r"\bcedex\b\s*\d{0,2}\b")
_PREFIX = re.compile(r"\b(?:plot|door|shop|house|flat|site|gala|survey|sy|h|d)\W{0,2}\s*no\b\W{0,2}\s*(?=\d)|\b(?:plot|door|shop|house)\b\W{0,2}\s*(?=\d)|\bno\b\W{0,2}\s*(?=\d)|\bn[°º]\s*(?=\d)")
_NUMBER = re.compile(r"(?<![\w/-])#?\s?(\d{1,5})\s*(?:/\s*\d+\s*)?(bis|ter|quater)?(?:\s*-?\s*([a-d]))?(?![\w])")
_HASH = re.compile(r"#\s?\d+[a-z]?\b")
_AREA = re.compile(r"\b(?:industrial|indl|ind)\s*\.?\s*area\b|\bi\s*\.?\s*a\b\.?")
_PIECE = re.compile(r"[^\W_]+|@")
_HINT_IA = re.compile(r"i(?<!\wi)\s*\.?\s*a\b").search
_HINT_UNIT = re.compile(r"\b(?:s(?:ui)?te|unit|ap|flat|r(?:oo)?m|b(?:ui)?ld|bat|esc|f(?:oo)?l|block|blk|tower)").search
_RUN = re.compile(r"\d+").finditer
_FIGURES = re.compile(r"\d+").findall
_SIX = re.compile(r"(?<!\d)(?:\d{6}|\d{3}[ -]\d{3})(?!\d)").search
_PIN = re.compile(r"\bpin\b(?:\s*code)?\W*").fullmatch
_CUT = re.compile(r"[,;]|\s-\s|\s-(?=\w)|-\s")


class Address(NamedTuple):
    number: str
    postcode: str
    compass: str
    street: str
    areas: list[str]
    unit: str = ""


def read_address(raw: str | None) -> Address | None:
    """Null, empty and blank addresses denote nothing. A missing part is the empty string. Words are sound keys, kinds of
    streets in full at the end of the street; ``12 bis`` is the number 12bis."""
    if not raw:
        return None
    t = plain(raw)
    if not t:
        return None
    if "near" in t or "nr" in t or "opp" in t or "behind" in t or "beside" in t or "next" in t or "adj" in t or "facing" in t or "in front" in t:
        t = _LANDMARK.sub(" , ", t)
    if "cedex" in t:
        t = _CEDEX.sub(" ", t)
    if "fl" in t or "etage" in t:
        t = _FLOOR.sub(" , ", t)
    if "wing" in t:
        t = _WING.sub(" ", t)
    units: list[str] = []
    postcode, start, end = _postcode(t)
    if postcode:
        t = t[:start] + " ; " + t[end:]
    if "ind" in t or _HINT_IA(t):
        t = _AREA.sub(" industrialarea ", t)
    if ("ste" in t or "suite" in t or "unit" in t or "ap" in t or "flat" in t or "rm" in t or "room" in t or "bld" in t or "build" in t or "bat" in t or "esc" in t or "fl" in t or "block" in t or "blk" in t or "tower" in t) and _HINT_UNIT(t):
        units = _UNIT.findall(t)
        t = _UNIT.sub(" , ", t)
    if "no" in t or "plot" in t or "door" in t or "shop" in t or "house" in t or not t.isascii():
        t = _PREFIX.sub(" ", t)
    if "#" in t and _HASH.search(t) and re.search(r"(?<![\d#])\d{1,5}\b", _HASH.sub(" ", t)):
        units += _HASH.findall(t)
        t = _HASH.sub(" , ", t)
    number = ""
    if m := _NUMBER.search(t):
        number = str(int(m[1])) + (m[2] or "")
        t = t[: m.start()] + " @ " + t[m.end() :]
    parts: list[_Part] = []
    for seg in _CUT.split(t) if "-" in t else t.replace(";", ",").split(","):
        parts += _parts(seg)
    at = marked = None
    for i, p in enumerate(parts):
        if p.street and at is None:
            at = i
        if p.marked and marked is None:
            marked = i
    if marked is not None and not parts[marked].kind:
        near = [i for i in (marked, marked + 1, marked - 1) if 0 <= i < len(parts)]
        at = next((i for i in near if parts[i].kind), at if at is not None else next((i for i in near if len(parts[i].words) > parts[i].marked), None))
    elif marked is not None:
        at = marked
    areas = [x for i, p in enumerate(parts) if i != at and (x := p.area if p.area is not None else p.read_area())]
    unit = next((u for x in units if (u := re.sub(r"\D", "", x))), "") if units else ""
    if at is None:
        return Address(number, postcode, "", "", areas, unit)
    p = parts[at]
    street, compass, rest = p.read or p.read_street()
    if rest:
        areas.insert(sum(bool(p.area) for p in parts[:at]), rest)
    return Address(number, postcode, compass, street, areas, unit)


def _postcode(t: str) -> tuple[str, int, int]:
    """The last five figures on their own, else the first six, which may be cut in two and follow the word pin; where in
    the text they begin and end."""
    last = t[-5:]
    if len(last) == 5 and last.isdecimal() and not t[-6:-5].isdecimal():
        return last, len(t) - 5, len(t)
    for figures in reversed(_FIGURES(t)):
        if len(figures) == 5:
            a = t.rfind(figures)
            b = a + 5
            if (a and t[a - 1].isdigit()) or t[b : b + 1].isdigit() or t[b : b + 1] == "-":
                break  # within a longer number further on, or with a second part: the long way
            return figures, a, b
    else:
        if not (m := _SIX(t)):
            return "", 0, 0
        a, b = m.span()
        at = t.rfind("pin", 0, a)
        return t[a : a + 3] + t[b - 3 : b], at if at >= 0 and (not at or not (t[at - 1].isalnum() or t[at - 1] == "_")) and _PIN(t[at:a]) else a, b
    runs = [m.span() for m in _RUN(t)]
    for j in range(len(runs) - 1, -1, -1):
        a, b = runs[j]
        if b - a == 5:
            more = j + 1 < len(runs) and runs[j + 1][0] == b + 1 and t[b] == "-" and runs[j + 1][1] - runs[j + 1][0] == 4
            return t[a:b], a, runs[j + 1][1] if more else b
    return "", 0, 0


class _Part:
    """What lies between two commas. Its area and its street are read when they are asked for: of most parts it is one."""

    __slots__ = ("area", "kind", "marked", "read", "street", "words")

    def __init__(self, words: list[str]):
        self.words = words
        self.marked = "@" in words  # holds the place of the house number
        self.kind = not _KINDS.isdisjoint(words)  # holds a kind of street
        # holds one after its first word, or is one, and more than that
        self.street = self.kind and (self.marked or len(words) > 1) and not _KINDS.isdisjoint(words[1:] or words)
        self.area: str | None = None
        self.read: tuple[str, str, str] | None = None

    def read_area(self) -> str:
        self.area = " ".join([sound(w) for w in self.words if w != "@" and w != "pin"])
        return self.area

    def read_street(self) -> tuple[str, str, str]:
        """(street, compass point, area that follows the street without a comma)"""
        street, rest = _cut([w for w in self.words if w != "@" and w != "pin"])
        compass = ""
        if len(street) > 1 and street[0] in COMPASS:
            compass, street = COMPASS[street[0]], street[1:]
        if len(street) > 1 and street[-1] in COMPASS:
            compass, street = COMPASS[street[-1]], street[:-1]
        self.read = _street(street), compass, " ".join(map(sound, rest))
        return self.read


@lru_cache(maxsize=1 << 16)
def _parts(seg: str) -> tuple[_Part, ...]:
    """What lies between two commas, as one part or, where an area stands before the house number, two. The same pieces
    come again and again, so what is read of them is kept."""
    words = seg.split() if seg.replace(" ", "").isalnum() else _PIECE.findall(seg.replace("'", " "))
    out = []
    if "@" in words:
        j = words.index("@")
        if j and not _KINDS.isdisjoint(words[j + 1 :]):  # an area, then number and street, without a comma
            out.append(words[:j])
            words = words[j:]
        words = ["@", *(w for w in words if w != "@")]
    first = 1 if words[:1] == ["@"] else 0
    if words[first : first + 1] == ["r"] and len(words) > first + 1:
        words[first] = "rue"
    if words:
        out.append(words)
    return tuple(map(_Part, out))


def _cut(words: list[str]) -> tuple[list[str], list[str]]:
    """A street and what follows it without a comma. Kinds that stand before the name leave no sign of its end."""
    if words and STREETS.get(words[0]) in FRONT | EITHER:
        return words, []
    for i, w in enumerate(words):
        if i and STREETS.get(w) and not (i + 1 < len(words) and STREETS.get(words[i + 1])):
            end = i + 1
            if end < len(words) and words[end] in COMPASS and len(words[end]) == 1 and end + 1 >= len(words):
                end += 1
            return words[:end], words[end:]
    return words, []


_LINK = frozenset("de du des d la le les l".split())


def _street(words: list[str]) -> str:
    """The kind of street last, links left out: ``rue du Pont`` and ``pont rue`` agree."""
    words = [w for w in words if w not in _LINK]
    if not words:
        return ""
    if STREETS.get(words[0]) in FRONT | EITHER and len(words) > 1:
        words = [*words[1:], words[0]]
    kind = STREETS.get(words[-1]) if len(words) > 1 else None
    name = [sound(w) for w in (words[:-1] if kind else words)]
    return " ".join([*name, kind or "?"])
