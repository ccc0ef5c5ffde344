"""The two normalizers and the scalar functions on their tokens, as Column expressions.

Only what Spark has no expression for runs in Python, in Arrow batches: Unicode decomposition and case folding. Strings
that are ASCII already skip the work there.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinlink.functions.wordlists import ADDRESS_NOISE, ADDRESS_STOP, ADDRESS_WORDS, LEGAL_SUFFIXES, LEGAL_TERMS

#: Python's \w over all of Unicode: letters, numbers, underscore
WORD = r"[\p{L}\p{N}_]+"


def fold_ascii(text: str | None) -> str:
    """Compatibility decomposition, all that isn't ASCII dropped, lower case."""
    if not text:
        return ""
    return (text if text.isascii() else unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()).lower()


def fold_unicode(text: str | None) -> str:
    """Compatibility decomposition without combining marks, case-folded."""
    if not text:
        return ""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).casefold()


def _batched(f, column: Column | str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(f)

    return F.pandas_udf(run, T.StringType())(column)


def words(column: Column | str) -> Column:
    """Maximal runs of word characters, in order."""
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def without(tokens: Column, listed: tuple[str, ...], shortest: int = 1) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*listed) & (F.length(t) >= shortest))


def clean_text(column: Column | str) -> Column:
    """Folded to ASCII, punctuation as blanks, blanks squeezed; null gives the empty string."""
    return F.trim(F.regexp_replace(_batched(fold_ascii, column), r"[^a-z0-9_]+", " "))


def _split(clean: Column) -> Column:
    return F.filter(F.split(clean, " "), lambda t: t != "")


def name_tokens(clean: Column) -> Column:
    """Words of a cleaned name that are neither a legal form nor a single character, repeated ones kept."""
    return without(_split(clean), LEGAL_TERMS, 2)


def address_tokens(clean: Column) -> Column:
    return without(_split(clean), ADDRESS_NOISE, 2)


def canonical(tokens: Column) -> Column:
    """Sorted tokens in one string."""
    return F.array_join(F.array_sort(tokens), " ")


def digit_words(column: Column | str) -> Column:
    """Words of the raw text that are made of digits only."""
    return F.array_distinct(F.filter(words(column), lambda t: t.rlike(r"^\p{Nd}+$")))


def digit_runs(column: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(column, F.lit(r"\p{Nd}+"), F.lit(0)))


def strip_suffixes(tokens: Column, listed: tuple[str, ...] = LEGAL_SUFFIXES) -> Column:
    """Tokens up to the last one that isn't listed."""
    keep = F.array_max(F.transform(tokens, lambda t, i: F.when(t.isin(*listed), 0).otherwise(i + 1)))
    return F.when(F.size(tokens) == 0, tokens).otherwise(F.slice(tokens, 1, keep))


def written_out(tokens: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in ADDRESS_WORDS.items() for x in pair])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def normal_name(column: Column | str) -> Column:
    return F.array_join(strip_suffixes(words(_batched(fold_unicode, column))), " ")


def normal_address(column: Column | str) -> Column:
    return F.array_join(written_out(words(_batched(fold_unicode, column))), " ")


def parts(normal: Column) -> Column:
    """Tokens of a normalized text."""
    return _split(normal)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def containment(a: Column, b: Column) -> Column:
    """Shared part of the smaller set; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def trigrams(column: Column) -> Column:
    """Distinct letter triples of a text between blanks; none for the empty text."""
    padded = F.concat(F.lit(" "), column, F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substr(padded, i, F.lit(3)))
    return F.when(F.length(column) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(each))


def smaller_share(a: Column, b: Column) -> Column:
    """Smaller by larger of two counts; 0 if both are 0."""
    return F.when(F.greatest(a, b) == 0, 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def longest_first(tokens: Column, n: int) -> Column:
    """The n longest distinct tokens; of equally long ones the greater first."""
    ranked = F.sort_array(F.transform(F.array_distinct(tokens), lambda t: F.struct(F.length(t).alias("l"), t.alias("t"))), asc=False)
    return F.slice(ranked["t"], 1, n)


def name_terms(normal: Column) -> Column:
    return F.filter(parts(normal), lambda t: F.length(t) >= 2)


def address_terms(normal: Column) -> Column:
    return without(parts(normal), ADDRESS_STOP, 3)


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of one big integer."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """1 less insertions and deletions by the lengths; 0 if either is empty."""
    return 2 * common_length(a, b) / (len(a) + len(b)) if a and b else 0.0


def sorted_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def ratio_columns(name_a: str, name_b: str, address_a: str, address_b: str) -> Column:
    """Struct of the three sequence similarities of a pair, in one Arrow exchange."""

    def run(na: pd.Series, nb: pd.Series, aa: pd.Series, ab: pd.Series) -> pd.DataFrame:
        rows = [(indel_ratio(p, q), sorted_ratio(p, q), sorted_ratio(r, s)) for p, q, r, s in zip(na, nb, aa, ab, strict=True)]
        return pd.DataFrame(rows, columns=["name_sequence_ratio", "name_sorted_ratio", "address_sorted_ratio"], dtype=float)

    kind = T.StructType([T.StructField(c, T.DoubleType()) for c in ("name_sequence_ratio", "name_sorted_ratio", "address_sorted_ratio")])
    return F.pandas_udf(run, kind)(name_a, name_b, address_a, address_b)


def id_list(column: Column | str) -> Column:
    """Elements of a comma list, empty ones left out."""
    return F.filter(F.split(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")), ","), lambda x: x != "")


def bucket(column: Column | str, n: int) -> Column:
    """Stable bucket of an id: the first 16 bits of its SHA-256, modulo n."""
    c = F.col(column) if isinstance(column, str) else column
    return F.pmod(F.conv(F.substring(F.sha2(c, 256), 1, 4), 16, 10).cast("int"), F.lit(n))
