"""One consistent form for texts that look the same but hold different characters: script-aware repair.

Plain texts (ASCII and composed Latin letters, single blanks) are their own form and never leave the JVM. The others are
folded (looks.visual_fold) and cut into tokens. A token whose letters come from several scripts, or from another script
than the text around it, is respelled in its dominant script, but only if that spelling is in the vocabulary of the
corpus, among the tokens of all texts that need no repair. The vocabulary is joined as a table; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinlink.llm.looks import PIECE, dominant, repairs, script, visual_fold
from kinlink.scratch import Scratch

#: composed Latin letters that look like nothing else; ligatures, digraphs, the long s and letters with a loose dot do
_LATIN = "À-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ"
#: single-blank texts of ASCII and those letters, without blanks at the ends
PLAIN = rf"^(?:[!-~{_LATIN}]+(?: [!-~{_LATIN}]+)*)?$"
#: whether a token in one script is respelled too, where the text around it is in another
AROUND = True
#: whether a spelling that the vocabulary lacks is accepted if two different spellings lead to it
TWICE = False
_SPLIT = r"[^\p{L}\p{N}]+"


def _fold(around_too: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            folded = [visual_fold(t) for t in b["text"]]
            pieces, spellings = [], []
            for t in folded:
                p = PIECE.findall(t)
                around = dominant(t) if around_too else ""
                alts = [(x, y, i) for x in dict.fromkeys(p) if not x.isascii() and (around_too or len({s for s in map(script, x) if s}) > 1) for i, y in enumerate(repairs(x, around))]
                pieces.append(p)
                spellings.append([{"token": x, "spelling": y, "rank": i} for x, y, i in alts])
            yield b.assign(pieces=pieces, spellings=spellings)

    return run


def consistent_forms(texts: DataFrame, by: list[str] | None = None, around: bool = AROUND, twice: bool = TWICE, scratch: Scratch | None = None) -> DataFrame:
    """Adds ``form`` to texts(text, ...): the one form of all texts that look the same. Vocabularies are kept apart by the
    columns ``by`` (non-null). Null gives null, an empty or invisible text the empty string. Rows are kept as they are,
    repeated ones too. A foreign word in its own script stays: nothing in the vocabulary asks for another spelling."""
    by = by or []
    own = texts.columns
    if clash := {"form", "pieces", "spellings", "_key"} & set(own):
        raise ValueError(f"columns {sorted(clash)} are made here; rename them")
    plain = texts.where(F.col("text").isNull() | F.col("text").rlike(PLAIN)).withColumn("form", F.col("text"))
    special = texts.where(F.col("text").isNotNull() & ~F.col("text").rlike(PLAIN))
    keyed = special.select(*by, "text").distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keyed.schema)
    scratch = scratch or Scratch(texts.sparkSession, "lookalike")
    folded = keyed.mapInPandas(_fold(around), f"{kinds}, pieces array<string>, spellings array<struct<token:string,spelling:string,rank:int>>")
    folded = scratch.cut(folded)  # used by all that follows
    clean = folded.where(F.size("spellings") == 0).select(*by, "text", F.array_join("pieces", "").alias("form"))
    broken = folded.where(F.size("spellings") > 0)
    wanted = broken.select(*by, F.explode("spellings").alias("s")).select(*by, "s.*").distinct()
    words = lambda d, c: d.select(*by, F.explode(F.split(F.col(c), _SPLIT)).alias("spelling"))
    vocabulary = words(plain.where("text is not null"), "text").union(words(clean, "form")).where("spelling <> ''")
    led = wanted.where("rank = 0" if twice else "false").groupBy(*by, "spelling").agg(F.countDistinct("token").alias("n")).where("n > 1").drop("n")
    # only spellings that are asked for are looked up: the semi join runs before the distinct
    known = vocabulary.join(wanted.select(*by, "spelling").distinct(), [*by, "spelling"], "left_semi").union(led.select(*by, "spelling")).distinct()
    accepted = wanted.join(known, [*by, "spelling"]).groupBy(*by, "token").agg(F.min(F.struct("rank", "spelling")).alias("s")).select(*by, "token", F.col("s.spelling").alias("spelling"))
    each = broken.select(*by, "text", F.explode("spellings.token").alias("token")).distinct().join(accepted, [*by, "token"])
    maps = each.groupBy(*by, "text").agg(F.map_from_entries(F.collect_list(F.struct("token", "spelling"))).alias("m"))  # at most the tokens of one text
    mended = broken.join(maps, [*by, "text"], "left").select(*by, "text", F.array_join(F.transform("pieces", lambda p: F.coalesce(F.try_element_at("m", p), p)), "").alias("form"))
    forms = clean.union(mended)
    return plain.select(*own, "form").union(special.join(forms, [*by, "text"]).select(*own, "form"))



def same_looking(records: DataFrame, by: list[str], around: bool = AROUND, twice: bool = TWICE) -> DataFrame:
    """(by..., entity_id_a, entity_id_b) with entity_id_a < entity_id_b: records(by..., entity_id, text) whose texts differ as
    strings and have one form. Null and empty texts look like nothing; an id delivered twice counts once. Only texts that
    are not their own form are probed against all others, so a text in many exact copies meets just its look-alikes."""
    scratch = Scratch(records.sparkSession, "lookalike")
    rows = scratch.cut(consistent_forms(records.where("text is not null and entity_id is not null").select(*by, "entity_id", "text").distinct(), by, around, twice, scratch).where("form <> ''"))
    odd = rows.where("text <> form").select(*by, "form", F.col("entity_id").alias("odd_id"), F.col("text").alias("odd_text"))
    pairs = odd.join(rows, [*by, "form"]).where("odd_text <> text and odd_id <> entity_id")
    return pairs.select(*by, F.least("odd_id", "entity_id").alias("entity_id_a"), F.greatest("odd_id", "entity_id").alias("entity_id_b")).distinct()
