"""Reading names of organisations and people: tokens, common words, given names, and whether two names are forms of one."""

from __future__ import annotations

import re

from kinlink.llm.translit import plain, skeleton, sound

# Legal forms, forms of address and words that say nothing about who is meant.
LEGAL = frozenset("llc llp pllc inc incorporated corp corporation ltd limited co coy company private pvt p sarl sas sasu sa eurl snc sca scop gie societe ste gmbh ag bv nv spa srl pty plc lp pc lllp kanpani praivet".split())
TITLES = frozenset("dr mr mrs ms miss smt shri sri shree me maitre prof mme mlle m messrs ms kumari the".split())
NOISE = frozenset("and et und y n plus one hq new mgmt branch formerly ex des de du la le les of".split())
# Common words of trades, and how they are shortened.
TRADES = frozenset(
    "accounting advocate agency agro architecte architect artisanale associates assurance attorney auto automobile batiment beaute bhandar boulangerie brothers builders cabinet care caterers center centrale chauffage chemical clinic coffee coiffure cold conseil construction consulting contractors cpa credit dds dental dentaire design developpement diagnostic distribution ebeniste electric electricite electronics engineering enterprises equipment evenements exports eye fabrication family fermiere fils flooring food foret freight fromagerie furniture garage garden garments generale grooming group groupe hardware holdings home hospital house imports immobilier industries ingenierie innovation insurance internationaux international jewellers laboratory laboratories landscape law librairie maconnerie management manufacturing marble marine mechanical medical medicale medicine media menuiserie metal mills moving notaire office optique packaging papeterie parts paysagiste pepinieres pet pharmacie photographe photography physical plomberie plumbing polymers press print printing produce products property realty repair roasters roofing sales school services shop software sons spices steel storage stores supply sweets systems tailoring tax technologies textile therapy trading traders traiteur transport transports travel veterinary wholesale window works".split()
)
SHORT = dict(x.split(":") for x in "assoc:associates bat:batiment blg:boulangerie boul:boulangerie bros:brothers cab:cabinet cie:company cntr:center ctr:center centre:center chem:chemical const:construction constr:construction dent:dental dev:developpement elec:electronics electr:electronics eng:engineering engg:engineering engrs:engineering ent:enterprises entp:enterprises fab:fabrication gen:generale gr:group grp:group grpe:groupe hosp:hospital imm:immobilier ind:industries inds:industries indl:industries ing:ingenierie ins:insurance int:international intl:international lab:laboratory labs:laboratory med:medical mfg:manufacturing mgmt:management mgt:management pharm:pharmacie photo:photography prod:products prods:products prop:property serv:services service:services svc:services svcs:services soc:societe tech:technologies technol:technologies technology:technologies ther:therapy trans:transport transp:transport trpt:transport vet:veterinary whse:wholesale agcy:agency ag:agency dist:distribution distr:distribution mkt:marketing natl:national contrs:contractors conrs:contractors contr:contractors phie:pharmacie tpt:transport tpts:transport bradars:brothers gle:generale eksaports:exports teksatail:textile oto:auto egro:agro phud:food pharnichar:furniture haus:house sarvisej:services".split())
# Given names with their short and pet forms, the given name first.
PET_NAMES = """alexandra alex sandra lexi|alexander alex sandy xander|andrew andy drew|anthony tony|barbara barb|benedicte bene|benjamin ben benny|bernard bernie|catherine cathy kate cate katy cath|katherine kathy kate kat katie kay|charles charlie chuck chas|charlotte lottie|christine chris chrissy|christophe chris|christopher chris kit|daniel dan danny|david dave davy|deborah deb debbie debby|donald don donnie|dorothy dot dottie dolly|edward ed eddie ned ted teddy|elizabeth liz beth betty eliza lizzie betsy|elisabeth babette lise lisette|emmanuel manu|francois fanfan|frederic fred fredo|frederick fred freddie|genevieve ginette|gerard gege|gopal gopu|guillaume guy gui will|harish hari|helene lena|henry harry hank|jacqueline jackie jacky|jacques jacky|james jim jimmy jamie|jean jeannot|jennifer jen jenny|john jack johnny|jonathan jon|joseph joe joey jojo|kenneth ken|krishnan krish kris kishan kishna|lakshmi laxmi lacchmi|lawrence larry|laurent lolo|linda lindy|margaret maggie meg peggy marge greta|mary molly polly|matthew matt|michael mike mick mickey|mohammed mohd md muhammad mohamed mohammad|nathalie nath|nicholas nick|nicolas nico|pamela pam|patricia pat patty trish tricia|patrick pat paddy|philippe phil|pradeep pradip deepu|rajendra raj rajinder raju rajan|rebecca becky|richard rich rick dick richie ricky|robert rob bob bobby bert robbie|ronald ron ronnie|samuel sam sammy|saraswati sarasvati saras saru|sebastien seb|stephane steph|stephen steve|steven steve|sunita suneeta sunitha suni|susan sue susie|susannah susan sue susie suzy sanna|suzanne suzy|theodore theo ted teddy|therese tess|thierry titi|thomas tom tommy|timothy tim|valerie val|veronique vero|venkatesh venkat venky|victoria vicky|vincent vince|virginie gigi|vishwanath vishu vishwa viswanath|william will bill billy willie|xavier xav|yves yvon|chandrika chandra chandu|baptiste titou"""
_PETS: dict[str, set[str]] = {}
for _line in PET_NAMES.split("|"):
    for _n in _line.split():
        _PETS.setdefault(_n, set()).add(_line.split()[0])
GIVEN = frozenset(x.split()[0] for x in PET_NAMES.split("|"))

#: long legal forms, and what is left of them when a letter is lost
_LONG_LEGAL = frozenset(w[:i] + w[i + 1 :] for w in LEGAL if len(w) >= 6 for i in range(len(w))) | frozenset(w for w in LEGAL if len(w) >= 6)
_WORD = re.compile(r"[^\W_]+")
_DBA = re.compile(r"\b(?:d ?[./]? ?b ?[./]? ?a|t/a|a\.?k\.?a|trading as|doing business as|formerly|nom commercial|c/o)\b\.?", re.I)
_SITE = re.compile(r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.[a-z]{2,8}(?:\.[a-z]{2,3})?/?$")
_INNER_SITE = re.compile(r"(?:https?://)?(?:www\.[a-z0-9-]+\.[a-z]{2,8}|[a-z0-9-]{5,}\.(?:example|com|fr|in|net|org|biz))\b")
_BRACKETS = re.compile(r"\((?!p\))([^)]*)\)")
_MARKED = re.compile(r"[.(/#']").search
_HINT_DBA = re.compile(r"d[ ./]{0,3}b[ ./]{0,3}a").search
_DOTTED = re.compile(r"\b(?:[a-z]\.){2,}[a-z]?\b\.?")


def read_name(raw: str | None) -> list[tuple[list[str], bool]]:
    """The names in a string, each as its tokens in order with whether they are written together as one (a site, a hash
    tag). "A DBA B" holds two names. Null, empty and letterless strings hold none."""
    if not raw:
        return []
    text = plain(raw)
    if not _MARKED(text) and not ("aka" in text or "dba" in text or "d ba" in text or "b a" in text or "trading" in text or "doing b" in text or "formerly" in text or "nom c" in text):
        words = _WORD.findall(text)  # neither marks nor a second name: the many plain names
        return [(words, len(words) == 1 and len(words[0]) >= 14)] if words else []
    out = []
    parts = [text]
    if " " in text:
        sites = []
        if "www." in text or ".example" in text or ".com" in text or ".fr" in text or ".in" in text or ".net" in text or ".org" in text or ".biz" in text or not text.isascii():
            sites = [m.group() for m in _INNER_SITE.finditer(text)]
            parts = [_INNER_SITE.sub(" ", text)]
        if sites or "/" in text or "k.a" in text or ".ka" in text or "aka" in text or "trading" in text or "doing b" in text or "formerly" in text or "nom c" in text or _HINT_DBA(text) or not text.isascii():
            parts = _DBA.split(parts[0])
        parts += sites
    parts += [] if "(" not in text else [m for m in _BRACKETS.findall(text) if sum(map(len, _WORD.findall(m))) >= 10 and not set(_WORD.findall(m)) & NOISE]
    for part in parts:
        part = (_BRACKETS.sub(" ", part) if "(" in part else part).strip(" -;,/")
        if m := _SITE.match(part):
            out.append(([m.group(1).replace("-", "")], True))
            continue
        if part.startswith("#") and " " not in part:
            out.append((["".join(_WORD.findall(part))], True))
            continue
        part = (_DOTTED.sub(lambda m: m.group().replace(".", ""), part) if "." in part else part).replace("int'l", "intl").replace("'", " ")
        words = _WORD.findall(part)
        if words:
            out.append((words, len(words) == 1 and len(words[0]) >= 14))
    return out


class Vocabulary:
    """Common words of the names of a corpus: the trades above, given names, and every token in at least a share of all
    names. Bounded: at most mean tokens a name / share words come from the corpus."""

    def __init__(self, words: dict[str, int]):
        self.common = {w: n for w, n in words.items() if len(w) > 1 and w not in LEGAL and w not in TITLES} | {w: words.get(w, 1) for w in TRADES | GIVEN}
        ranked = sorted((w for w in self.common if w not in SHORT), key=lambda w: (-self.common[w], w))
        self.close: dict[str, str] = {}
        self.bones: dict[str, str] = {}
        for w in ranked:
            if len(w) >= 5:
                for i in range(len(w)):
                    self.close.setdefault(w[:i] + w[i + 1 :], w)
            if len(skeleton(w)) >= 2:
                self.bones.setdefault(skeleton(w), w)
        self.near = self.common.keys() | self.close.keys()
        self.short: dict[str, str] = {}  # beginnings of common words that are longer by two letters or more
        self.by_first: dict[str, list[str]] = {}
        for w in ranked:
            if w not in GIVEN:
                self.by_first.setdefault(w[0], []).append(w)
                for n in range(4, min(7, len(w) - 2) + 1):
                    self.short.setdefault(w[:n], w)
        self.memo: dict[str, tuple[str, str]] = {}
        self.kind = kinds({*self.common, *SHORT.values()})

    def meaning(self, t: str) -> tuple[str, str]:
        """What _meaning says, a rare word as its sound key. Kept for the words seen last."""
        got = self.memo.get(t)
        if got is None:
            if len(self.memo) >= 1 << 17:
                self.memo.clear()
            kind, w = self._meaning(t)
            got = self.memo[t] = (kind, sound(w) if kind == "rare" else w)
        return got

    def cut(self, whole: str) -> list[str]:
        """A name written as one word, cut at known words at its beginning and end. The longest go first; what is left, four
        letters or more, stays one word."""
        def known(w: str) -> bool:
            if w in self.common or w in _PETS or w in SHORT:
                return True  # or one edit from a long word
            return len(w) >= 6 and (w in self.close or len(w) > 6 and not self.near.isdisjoint([w[:i] + w[i + 1 :] for i in range(len(w))]))

        head: list[str] = []
        tail: list[str] = []
        for _ in range(8):
            n = len(whole)
            if k := next((k for k in range(min(15, n - 4), 3, -1) if known(whole[:k])), 0):
                head.append(whole[:k])
                whole = whole[k:]
            elif k := next((k for k in range(min(15, n - 4), 2, -1) if whole[-k:] in LEGAL or (known(whole[-k:]) if k > 3 else tail and whole[-k:] in TRADES)), 0):
                tail.insert(0, whole[-k:])
                whole = whole[:-k]
            else:
                break
        return [*head, whole, *tail]

    def _meaning(self, t: str) -> tuple[str, str]:
        """(kind, word) of a token: legal, title, noise, given, common, initial, number or rare."""
        if t in LEGAL:
            return "legal", t
        if t in TITLES:
            return "title", t
        if t in NOISE:
            return "noise", t
        if t.isdigit():
            return "number", t
        if t in SHORT:
            return "common", SHORT[t]
        if t in _PETS:
            return "given", t
        if t in self.common:
            return "common", t
        if len(t) == 1:
            return "initial", t
        n = len(t)
        less = [t[:i] + t[i + 1 :] for i in range(n)] if n >= 5 else []
        for key in (t, *less) if n >= 5 and (t in self.near or not self.near.isdisjoint(less)) else ():
            w = key if key in self.common else self.close.get(key)
            if w and -1 <= len(w) - n <= 1:
                return ("given" if w in _PETS else "common"), w
        if t in _LONG_LEGAL or n >= 6 and not _LONG_LEGAL.isdisjoint(less):
            return "legal", t
        if 4 <= n <= 7 and (w := self.short.get(t)):
            return "common", w
        if n == 3 and not set(t[1:]) & set("aeiou"):
            for w in self.by_first.get(t[0], ()):
                if len(w) >= 5 and _within(t, w):
                    return "common", w
        if len(t) >= 4 and (w := self.bones.get(skeleton(t))) and abs(len(w) - len(t)) <= 2 and len(skeleton(t)) >= 3:
            return ("given" if w in _PETS else "common"), w
        return "rare", t

    def reading(self, tokens: list[str]) -> dict:
        """core: the sound keys of rare tokens; common: trades and the like; given: given names; all: in order."""
        got: dict[str, list[str]] = {"rare": [], "common": [], "given": [], "initial": [], "raw": []}
        for t in tokens:
            kind, w = self.meaning(t)
            if kind == "rare":
                got["raw"].append(t)
            if kind in got:
                got[kind].append(w)
        got["initials"] = got.pop("initial")
        return got


def _within(short: str, long: str) -> bool:
    it = iter(long)
    return all(c in it for c in short)


def roots(name: str) -> set[str]:
    """The given names that a name is a form of."""
    return _PETS.get(name, {name})


def given_alike(a: str, b: str) -> bool:
    return a == b or bool(_PETS.get(a, {a}) & _PETS.get(b, {b})) or (len(a) == 1 or len(b) == 1) and a[0] == b[0]


def trades_alike(v: str, w: str) -> bool:
    return v == w or v[:4] == w[:4] or len(x := skeleton(v)[:4]) > 2 and x == skeleton(w)[:4]


def kinds(words: set[str]) -> dict[str, str]:
    """For each word one that stands for all that are alike, directly or through others."""
    first: dict[str, str] = {}

    def top(key: str) -> str:
        while first.setdefault(key, key) != key:
            key = first[key]
        return key

    for w in sorted(words):
        bones = skeleton(w)[:4]
        for key in (f"a {w[:4]}", *([f"b {bones}"] if len(bones) > 2 else [])):
            first[top(key)] = top(w)
    return {w: top(w) for w in words}


def common_conflict(a: list[str], b: list[str]) -> bool:
    """Both hold a word of a trade that the other doesn't."""
    return bool(a and b) and any(not any(trades_alike(v, w) for w in b) for v in a) and any(not any(trades_alike(v, w) for w in a) for v in b)


def given_conflict(a: list[str], b: list[str], initials_a: list[str], initials_b: list[str]) -> bool:
    """Both hold a given name and none of them agrees."""
    if a and b:
        return not any(given_alike(x, y) for x in a for y in b)
    if a and initials_b:
        return not any(x[0] == i for x in a for i in initials_b)
    if b and initials_a:
        return not any(x[0] == i for x in b for i in initials_a)
    return False
