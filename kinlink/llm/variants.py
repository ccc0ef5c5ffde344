"""Variant spellings of names: which names of two tables are forms of one organisation's or person's name.

Names are read into tokens (names.read_name) once per distinct string. Tokens that are common in the corpus or name a
trade are set apart from the rare ones; the sound keys of the rare tokens, sorted and joined, are the core. Cores are
linked by the pigeonhole segment join (passjoin), in both orders of two words, unless their trades or given names have
nothing in common. Names written together as one word are cut at known words at both ends, and compared as a whole too;
names written without vowels are linked by their consonants. A linked pair is then read as a whole: trades and given names
may be missing or shortened on one side but must not contradict each other. A pair whose cost is small for its length
stands; of the others, the nearest to each of the names in a string are kept (see forms).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinlink.llm.names import LEGAL, NOISE, Vocabulary, common_conflict, given_conflict, read_name, roots, trades_alike
from kinlink.llm.nearby import nearby
from kinlink.llm.passjoin import MOST, allowed, similar
from kinlink.llm.translit import skeleton, sound
from kinlink.llm.translit import strings as strings_of
from kinlink.scratch import Scratch

#: a token in at least this share of all names counts as common
COMMON_SHARE = 0.002
LEAST_COMMON = 6
Reading = tuple[list[str], bool, dict]


def common_words(readings: DataFrame, share: float = COMMON_SHARE) -> dict[str, int]:
    """Tokens in at least ``share`` of the names, with their numbers: at most (tokens a name) / share of them."""
    total = readings.count()
    each = readings.select(F.explode(F.array_distinct("tokens")).alias("t")).where(F.length("t") > 1)
    rows = each.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(LEAST_COMMON, share * total)).collect()
    return {r.t: r.n for r in rows}


def _first_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first = [list(dict.fromkeys(names[0][0])) for n in strings_of(b["name"]) if (names := read_name(n))]
        yield pa.RecordBatch.from_arrays([pa.array(first, pa.list_(pa.string()))], names=["t"])


def corpus_words(names: DataFrame, scratch: Scratch, share: float = COMMON_SHARE) -> dict[str, int]:
    """common_words of all distinct names(name). Names in ASCII are cut into words in the JVM, which reads sites and second
    names a little differently from read_name; only the others go through it, and of a second name nothing counts."""
    names = names.where("name is not null").distinct()
    ascii_ = F.col("name").rlike(r"^\p{ASCII}*$")
    cut = F.split(F.regexp_replace(F.lower("name"), "[.']", ""), "[^a-z0-9]+")
    words = names.where(ascii_).select(F.array_distinct(cut).alias("t")).union(names.where(~ascii_).mapInArrow(_first_words, "t array<string>"))
    every = F.concat(F.array_remove("t", ""), F.array(F.lit("")))  # the empty word stands for the name
    counts = scratch.cut(words.select(F.explode(every).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).where(f"n >= {LEAST_COMMON} or t = ''"))
    total = sum(r.n for r in counts.where("t = ''").collect())
    return {r.t: r.n for r in counts.where((F.length("t") > 1) & (F.col("n") >= share * total)).collect()}


def readings(name: str, vocabulary: Vocabulary) -> list[Reading]:
    """(tokens, together, what they are) of the names in a string. A name written as one word is cut at known words."""
    out = []
    for tokens, together in read_name(name):
        pieces = vocabulary.cut(tokens[0]) if together else tokens
        out.append((tokens, together, vocabulary.reading(pieces)))
    return out


def _keys(words: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        for b in batches:
            at: list[int] = []
            out: list[tuple[str, str, int, int]] = []
            for i, name in enumerate(strings_of(b["name"])):
                for r in readings(name, vocabulary):
                    m = marks(r[2], r[1], vocabulary)
                    new = [(use, s, m, bag(s)) for use, s in strings(*r)]
                    out += new
                    at += [i] * len(new)
            kept = b.select(["side", "n"]).take(pa.array(at, pa.int64()))
            columns = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True))], names=["side", "n", "use", "s", "m", "g"])

    return run


def wholes(tokens: list[str], together: bool) -> list[str]:
    """A name as one word; one written so also without an "and" that may stand in it."""
    if not together:
        return [sound("".join(t for t in tokens if t not in NOISE))]
    whole = tokens[0]
    return [sound(whole), *(sound(whole[: m.start()] + whole[m.end() :]) for m in re.finditer("and|et", whole[:-4]) if m.start() > 3)]


def bag(s: str) -> int:
    """A bit for each letter, and one for each that comes twice: an edit changes at most two of them."""
    out = 0
    for c in s:
        bit = 1 << (ord(c) & 31)
        out |= bit << 32 if out & bit else bit
    return out if out < 1 << 63 else out - (1 << 64)


#: bits for kinds of trades and for given names; then one each for initials and for a name written as one word
TRADE_BITS = 35
GIVEN_BITS = 26
INITIALS = 1 << TRADE_BITS + GIVEN_BITS
TOGETHER = INITIALS << 1


@lru_cache(maxsize=1 << 16)
def _bit(word: str, bits: int) -> int:
    return 1 << zlib.crc32(word.encode()) % bits


def marks(r: dict, together: bool, vocabulary: Vocabulary) -> int:
    """Sets of bits of the trades and the given names of a name, words that are alike having the same. See may_agree."""
    out = bool(r["initials"]) * INITIALS | together * TOGETHER
    for w in r["common"]:
        out |= _bit(vocabulary.kind.get(w, w), TRADE_BITS)
    for w in r["given"]:
        for root in roots(w):
            out |= _bit(root, GIVEN_BITS) << TRADE_BITS
    return out


def may_agree(a: Column, b: Column) -> Column:
    """What apart() asks of trades and given names, as far as marks tell: it is true of all pairs that apart() lets pass. Of
    names written as one word, which are also compared as a whole, less is asked."""
    part = lambda m, bits: m.bitwiseAND(F.lit(bits))
    has = lambda m, bits: part(m, bits) != 0
    trades, given = (1 << TRADE_BITS) - 1, (1 << GIVEN_BITS) - 1 << TRADE_BITS
    both = a.bitwiseAND(b)
    within = lambda x: part(both, trades) == part(x, trades)
    named = ~has(a, given) | ~has(b, given) | has(both, given)
    # a person against one without a given name: no trade but the person's
    person = lambda x, y: ~((has(x, given) | has(x, INITIALS) & ~has(x, trades)) & ~has(y, given | INITIALS)) | within(y)
    whole = ~has(a, trades) | ~has(b, trades) | has(both, trades)
    return F.when(has(a, TOGETHER) | has(b, TOGETHER), whole & (named | has(a, INITIALS) | has(b, INITIALS))).otherwise((within(a) | within(b)) & named & person(a, b) & person(b, a))


def strings(tokens: list[str], together: bool, r: dict) -> list[tuple[str, str]]:
    """(use, string) of a name. use: c core to be indexed, p core to probe with, b and q the same for consonants, f the whole
    name as one word, w the same of a name written so."""
    rare = r["rare"]
    out: list[tuple[str, str]] = []
    core = "".join(sorted(rare)) or "".join(sorted(map(sound, [*r["given"], *r["common"]])))
    if not core:
        return []
    for order in dict.fromkeys((core, "".join(rare), "".join(reversed(rare)) if len(rare) == 2 else "")):
        if order:
            out += [("c", order), ("p", order)] if order != "".join(reversed(rare)) or order == core else [("p", order)]
    out += [("w" if together else "f", w) for w in wholes(tokens, together)]
    bones = "".join(sorted(map(skeleton, rare)))
    if len(bones) >= 3:
        out.append(("b", bones))
        if any(len(t) >= 3 and not set(t) & set("aeiou") for t in r["raw"]):
            out.append(("q", bones))
    return out


def _osa(a: str, b: str, most: int) -> int:
    """Edit distance with swapped neighbours as one edit, within a band; most + 1 if it is more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if a == b:
        return 0
    older: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [most + 1] * len(b)
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], older[j - 2] + 1)
        if min(row) > most:
            return most + 1
        older, last = last, row
    return min(last[len(b)], most + 1)


def _tokens_apart(a: list[str], b: list[str]) -> float | None:
    """Edits between two sets of rare tokens, paired greedily; None if a token finds no partner. Words cut in two count
    as joined."""
    if not a or not b:
        return None
    joined = {("".join(sorted(a)), "".join(sorted(b))), ("".join(a), "".join(b))}
    if len(a) != len(b):  # one of them written together: in any order
        joined |= {("".join(reversed(a)), "".join(b)), ("".join(a), "".join(reversed(b)))}
    best = min(_osa(x, y, 3) for x, y in joined)
    n = min(len("".join(a)), len("".join(b)))
    if n < 5:  # so short that any edit makes another name
        return 0.0 if not best else None
    total, rest = 0.0, list(b)
    if len(a) == len(b):
        for x in sorted(a, key=len, reverse=True):
            got = min(((_near(x, y, len(a) > 1), y) for y in rest), default=(9.0, ""))
            if got[0] > 3 or got[0] == _LONGER and len(a) == 1:  # a lone word that goes on is another name
                total = 9.0
                break
            total += got[0]
            rest.remove(got[1])
    else:
        total = 9.0
    x, y = "".join(a), "".join(b)
    if min(len(a), len(b)) == 1 and (x.startswith(y) or y.startswith(x)) and abs(len(x) - len(y)) > 1:
        best = 9  # goes on: another name
    limit = 1 if n < 7 else 2 if n < 16 else 3
    found = [x for x in (total, float(best) if best <= limit else 9.0) if x < 9]
    return min(found) if found else None


#: cost of a word that is the beginning of another
_LONGER = 2.5


def _near(x: str, y: str, among: bool = False) -> float:
    """Edits between two tokens if they may be one; 9 if not. Among other words that agree, less is asked of one written
    without vowels."""
    n = min(len(x), len(y))
    d = _osa(x, y, 2)
    if d <= (0 if n < 4 else 1 if n < 9 else 2):
        return d
    bx, by = skeleton(x), skeleton(y)
    if n >= 3 and bx == by and len(bx) >= 3 and any(5 * sum(c in "aeiou" for c in t) <= len(t) for t in (x, y)):
        return 1.5
    if among and (not set(x) & set("aeiou") or not set(y) & set("aeiou")) and n >= 2 and bx[0] == by[0] and (bx == by or min(len(bx), len(by)) >= 3 and _osa(bx, by, 1) <= 1):
        return 2.0
    if len(x) >= 4 and len(y) >= 4 and (x.startswith(y) or y.startswith(x)) and n >= 5 and abs(len(x) - len(y)) <= 3:
        return _LONGER
    return 9.0


def apart(a: Reading, b: Reading) -> float | None:
    """Cost of taking two read names as forms of one; None if they aren't."""
    (ta, ga, ra), (tb, gb, rb) = a, b
    if bare_initials(ta, ra) or bare_initials(tb, rb):
        return None
    if ga or gb:  # written as one word: as a whole, whatever it is made of
        for x in wholes(ta, ga):
            for y in wholes(tb, gb):
                most = allowed(min(len(x), len(y)))
                if min(len(x), len(y)) >= 10 and (d := _osa(x, y, most)) <= most:
                    return float(d)
    if common_conflict(ra["common"], rb["common"]) or given_conflict(ra["given"], rb["given"], ra["initials"], rb["initials"]):
        return None
    for x, y in ((ra, rb), (rb, ra)):  # a person against one without a given name: no trade but the person's
        if (x["given"] or x["initials"] and not x["common"]) and not y["given"] and not y["initials"] and any(not any(trades_alike(v, w) for w in x["common"]) for v in y["common"]):
            return None
    if not ra["rare"] or not rb["rare"]:
        x, y = (sorted(map(skeleton, [*r["given"], *r["common"]])) for r in (ra, rb))
        return 0.0 if x and x == y and not ra["rare"] and not rb["rare"] else None
    d = _tokens_apart(ra["rare"], rb["rare"])
    if d is None:
        return None
    dropped = bool(ra["common"]) != bool(rb["common"]) and not (ra["given"] or rb["given"])
    if dropped and d > 0:
        return d + 0.5
    if not d and (dropped or bool(ra["given"] or ra["initials"]) != bool(rb["given"] or rb["initials"])):  # a name in full comes before one that lacks something
        return 0.25
    return d


def bare_initials(tokens: list[str], r: dict) -> bool:
    """No more than initials: one short word without vowels to speak it by, no word of a trade and no given name."""
    words = [t for t in tokens if t not in LEGAL]
    return len(words) == 1 and len(words[0]) <= 5 and not set(words[0]) & set("aeiouy") and not r["common"] and not r["given"] or all(len(t) == 1 for t in words)


def bare(r: dict) -> bool:
    """A rare word with nothing that says whose it is."""
    return len(r["rare"]) == 1 and not r["common"] and not r["given"] and not r["initials"]


def owner(r: dict) -> int:
    """A hash of the given names and trades: of what tells apart those who share a rare word."""
    return zlib.crc32("|".join((*sorted(min(roots(w)) for w in r["given"]), "", *sorted({skeleton(w)[:4] for w in r["common"]}))).encode())


def _core(a: Reading, b: Reading) -> int:
    return min(len("".join(r["rare"])) or len(t[0]) for t, _, r in (a, b))


def sure(cost: float, a: Reading, b: Reading) -> bool:
    """The cost is small for the shorter of two names: 1, or 2 from 12 letters on."""
    return cost <= (2 if _core(a, b) >= 12 else 1)


VERIFIED = "name_a string, name_b string, alt int, cost double, sure boolean, short boolean, bare_a boolean, bare_b boolean, owner_a bigint, owner_b bigint"


def _verify(words: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(words)
        memo: dict[str, list[Reading]] = {}

        def read(name: str) -> list[Reading]:
            if name not in memo:
                if len(memo) > 50_000:
                    memo.clear()
                memo[name] = readings(name, vocabulary)
            return memo[name]

        for b in batches:
            out = []
            for x, y in zip(b["name_a"], b["name_b"], strict=True):
                for alt, q in enumerate(read(y)):
                    best = min(((c, not sure(c, p, q), i) for i, p in enumerate(read(x)) if (c := apart(p, q)) is not None), default=None)
                    if best:
                        p = read(x)[best[2]]
                        out.append((x, y, alt, float(best[0]), not best[1], _core(p, q) < 12, bare(p[2]), bare(q[2]), owner(p[2]), owner(q[2])))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERIFIED.split(", ")])

    return run


def name_variants(left: DataFrame, right: DataFrame, scratch: Scratch | None = None, share: float = COMMON_SHARE) -> DataFrame:
    """(name_a, name_b, cost) of the distinct names of left(name) and right(name) that are forms of one name, equal strings
    included. Null, empty and letterless names are forms of nothing. cost: edits between their rare words."""
    return verified(left, right, scratch, share).groupBy("name_a", "name_b").agg(F.min("cost").alias("cost"))


def verified(left: DataFrame, right: DataFrame, scratch: Scratch | None = None, share: float = COMMON_SHARE) -> DataFrame:
    """(name_a, name_b, alt, cost, sure) of the pairs of name_variants, one row for each name alt in the string name_b."""
    scratch = scratch or Scratch(left.sparkSession, "variants")
    side = lambda d, x: d.select(F.lit(x).alias("side"), "name").where("trim(name) <> ''").distinct()
    both = scratch.cut(side(left, "a").union(side(right, "b")).withColumn("n", F.xxhash64("name")))
    words = corpus_words(both.select("name"), scratch, share)
    keyed = scratch.cut(both.mapInArrow(_keys(words), "side string, n bigint, use string, s string, m bigint, g bigint"))
    rows = lambda x, *u: keyed.where((F.col("side") == x) & F.col("use").isin(*u)).select("s", *[F.col(c).alias(f"{c}_{x}") for c in "nmg"]).distinct()
    agree = may_agree(F.col("m_a"), F.col("m_b"))
    found = None
    for i, p, marked in ((("a", "c"), ("b", "p"), True), (("a", "b"), ("b", "q"), True), (("b", "b"), ("a", "q"), True), (("a", "f", "w"), ("b", "w"), False), (("b", "f"), ("a", "w"), False)):
        if i[0] == "a" and marked:  # many strings on both sides
            one, two = rows(*i), rows(*p)
            near = scratch.cut(nearby(one, two, scratch))
            scratch.release()  # its shuffle files are many
            some = near.join(one.withColumnRenamed("s", "s_a"), "s_a").join(two.withColumnRenamed("s", "s_b"), "s_b")
        else:
            some = similar(rows(*i), rows(*p)).where(F.bit_count(F.col("g_a").bitwiseXOR(F.col("g_b"))) <= 2 * MOST)
        some = (some.where(agree) if marked else some).select("n_a", "n_b")
        found = some if found is None else found.union(some)
    found = scratch.cut(found.distinct())
    scratch.release()
    spelled = lambda x: both.where(F.col("side") == x).select(F.col("n").alias(f"n_{x}"), F.col("name").alias(f"name_{x}"))
    return scratch.cut(found.join(spelled("a"), "n_a").join(spelled("b"), "n_b").mapInPandas(_verify(words), VERIFIED))


def nearest(pairs: DataFrame, slack: float = 0.0) -> DataFrame:
    """Pairs whose cost is that of the nearest name_a for their name_b, or within ``slack`` of it."""
    least = pairs.groupBy("name_b").agg(F.min("cost").alias("least"))
    return pairs.join(least, "name_b").where(F.col("cost") <= F.col("least") + slack).drop("least")


def forms(pairs: DataFrame) -> DataFrame:
    """(name_a, name_b) of verified pairs that are sure, or the nearest to one of the names in name_b. Left out are pairs of
    short names that differ where the spelling of name_b is another name_a's own, and of a bare rare word that more than
    one owner, told apart by given name or trade, share."""
    own = lambda n, w: F.count_distinct(F.when(F.col(f"bare_{n}") & ~F.col(f"bare_{w}"), F.col(f"owner_{w}")))
    by_b = pairs.groupBy("name_b", "alt").agg(F.min("cost").alias("least"), F.max((F.col("cost") == 0) & (F.col("bare_a") == F.col("bare_b"))).alias("exact"), own("b", "a").alias("owners_a"))
    by_a = pairs.groupBy("name_a").agg(own("a", "b").alias("owners_b"))
    judged = pairs.join(by_b, ["name_b", "alt"]).join(by_a, "name_a")
    kept = (F.col("sure") | (F.col("cost") <= F.col("least"))) & ~(F.col("exact") & F.col("short") & (F.col("cost") > 0))
    shared = F.col("bare_b") & ~F.col("bare_a") & (F.col("owners_a") > 1) | F.col("bare_a") & ~F.col("bare_b") & (F.col("owners_b") > 1)
    return judged.where(kept & ~shared).select("name_a", "name_b").distinct()
