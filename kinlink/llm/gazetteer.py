"""Which addresses denote one location: a gazetteer made of the addresses themselves.

1. Every distinct address is read into number, postcode, street and areas (addresses.read_address).
2. Areas that keep to one zone of postcodes are localities, the others regions. Each postcode gets the locality named most
   often with it; rare spellings of areas and of the streets of a locality are clustered to the frequent spelling they are
   near to (segment join within the locality). An entry of the gazetteer is a locality with a street.
3. Every address is resolved by a beam over entries: hypotheses for the locality (its postcode; a locality's name, whole
   or as the beginning or end of a longer part; a near spelling), the best few of which are kept; in each of them the
   street as spelled, near to it, or without its kind. Addresses with neither postcode nor locality are resolved where
   street and number occur in a single place.
4. Addresses at one entry with one number, and without contradiction of postcode or compass point, are one location.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinlink.llm.addresses import read_address
from kinlink.llm.passjoin import similar
from kinlink.llm.translit import strings
from kinlink.llm.variants import _osa
from kinlink.scratch import Scratch

PARTS = {"number": pa.string(), "postcode": pa.string(), "compass": pa.string(), "street": pa.string(), "kind": pa.string(), "bare": pa.bool_(), "areas": pa.list_(pa.string())}
#: localities kept for an address
BEAM = 3
#: the occurrences of a locality keep to so many zones of postcodes (their first three digits), as a mean number of zones
#: (one by the sum of the squares of their shares); those of a region are in more
ZONES = 5
#: a spelling is taken for another if that one is so many times as frequent
RATIO = 2
#: edits for each letter that streets at one number of one postcode may differ by
LIKENESS = 0.3


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        there: list[int] = []
        out: dict[str, list] = {k: [] for k in PARTS}
        number, postcode, compass, street, kind, bare, areas = out.values()
        for i, raw in enumerate(strings(b["address"])):
            if r := read_address(raw):
                head, _, last = r.street.rpartition(" ")
                there.append(i)
                number.append(r.number)
                postcode.append(r.postcode)
                compass.append(r.compass)
                street.append(head or last)
                kind.append("" if last == "?" or not head else last)
                bare.append(last == "?")
                areas.append(r.areas)
        kept = b.select(["side", "id", "raw"]).take(pa.array(there, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(out[k], t) for k, t in PARTS.items())], names=["side", "id", "raw", *PARTS])


def read_addresses(records: DataFrame) -> DataFrame:
    """records(side, id, address) with the parts of the address; those that denote nothing are left out. street is the name,
    kind what kind of street it is, bare says that none was given. raw, n and code are hashes of the address, the number
    and the postcode, 0 for none; u is one of all that the locality and street are read from."""
    kinds = dict(records.dtypes)
    parts = "number string, postcode string, compass string, street string, kind string, bare boolean, areas array<string>"
    read = records.select("side", "id", F.xxhash64("address").alias("raw"), "address").mapInArrow(_read, f"side string, id {kinds['id']}, raw bigint, {parts}")
    known = F.col("postcode") != ""
    areas = F.when(known, F.array().cast("array<string>")).otherwise(F.col("areas"))
    code = F.when(known, F.xxhash64("postcode")).otherwise(F.lit(0).cast("bigint"))
    return read.withColumns({"n": F.xxhash64("number"), "code": code, "u": F.xxhash64("postcode", "street", "kind", "bare", areas)})


def _same_words(a: str, b: str) -> bool:
    """Words pair up with at most one edit (two in long ones), figures exactly; a word may be cut in two."""
    x, y = a.split(), b.split()
    if len(x) != len(y):
        return abs(len(x) - len(y)) == 1 and _osa("".join(x), "".join(y), 1) <= 1
    return all(p == q or not (p.isdigit() or q.isdigit()) and min(len(p), len(q)) > 2 and _osa(p, q, 2) <= (1 if min(len(p), len(q)) < 8 else 2) for p, q in zip(x, y, strict=True))


def _check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b[[_same_words(x, y) for x, y in zip(b["a"], b["b"], strict=True)]]


def _cluster(counted: DataFrame, text: str, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., text, canon, n): each spelling with the frequent spelling it is near to, itself if there is none. n is how
    frequent a spelling is in the corpus."""
    index = counted.where("n > 1").select(*by, F.col(text).alias("s"), F.col(text).alias("a"), F.col("n").alias("n_a"))
    probes = counted.select(*by, F.col(text).alias("s"), F.col(text).alias("b"), F.col("n").alias("n_b"))
    if by:  # nothing in its group is frequent enough for a spelling to be taken for it: it needn't be looked up
        probes = probes.withColumn("_m", F.max("n_b").over(W.partitionBy(*by))).where(f"_m >= {RATIO} * n_b").drop("_m")
    near = similar(index, probes, by=by).where(f"a <> b and n_a >= {RATIO} * n_b").select(*by, "a", "b", "n_a", "edits").distinct()
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in near.schema)
    best = near.mapInPandas(_check, kinds).groupBy(*by, "b").agg(F.min(F.struct("edits", (-F.col("n_a")).alias("m"), "a")).alias("best"))
    best = best.select(*by, F.col("b").alias(text), F.col("best.a").alias("canon"))
    return counted.join(best, [*by, text], "left").select(*by, text, F.coalesce("canon", text).alias("canon"), "n")


def _compact(rows: DataFrame) -> DataFrame:
    """Addresses with no more than the last steps need."""
    return rows.select("side", "id", "raw", "u", F.col("n").alias("number"), F.col("code").alias("postcode"), "compass")


def _localities(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(area, canon) of areas that keep to few zones of postcodes, and (postcode, place) of the locality named most often
    with a postcode. Areas by postcode are counted once; all else is made of these counts."""
    named = scratch.cut(rows.select("postcode", F.explode(F.array_distinct("areas")).alias("area")).where("length(area) > 1").groupBy("postcode", "area").agg(F.count(F.lit(1)).alias("n")))
    zoned = named.groupBy("area", F.when(F.col("postcode") != "", F.substring("postcode", 1, 3)).alias("zone")).agg(F.sum("n").alias("n"))
    inside = F.when(F.col("zone").isNotNull(), F.col("n").cast("double"))
    stats = zoned.groupBy("area").agg(F.sum("n").alias("n"), F.sum(inside).alias("m"), F.sum(inside * F.col("n")).alias("squares"))
    local = stats.where(f"m is null or {ZONES} * squares >= m * m")
    areas = scratch.cut(_cluster(local.select("area", "n"), "area").select("area", "canon"))
    coded = named.where("postcode <> ''").join(areas, "area").groupBy("postcode", "canon").agg(F.sum("n").alias("n"))
    place_of = coded.groupBy("postcode").agg(F.min(F.struct((-F.col("n")).alias("m"), "canon")).alias("x")).select("postcode", F.col("x.canon").alias("place"))
    return areas, scratch.cut(place_of)


def resolve(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(side, id, raw, entry, number, postcode, compass) of read addresses: entry is the number of the gazetteer entry that
    each is resolved to. An address may keep several equally good entries; one that fits none is left out. Streets and
    localities are worked on by spelling, each spelling u once; addresses are moved as a few numbers."""
    no_code = F.col("postcode") == ""
    rows = rows.where("number <> '' and street <> ''")
    areas, place_of = _localities(rows, scratch)
    own = F.when(no_code, F.col("areas")).otherwise(F.array().cast("array<string>")).alias("areas")
    spelled = scratch.cut(rows.groupBy("u", "postcode", "street", "kind", "bare", own).agg(F.count(F.lit(1)).alias("k")))

    kept = ("u", "street", "kind", "bare", "k")
    # by postcode: one hypothesis
    sure = spelled.where("postcode <> ''").join(place_of, "postcode", "left").select(*kept, F.coalesce("place", "postcode").alias("place"), F.lit(3.0).alias("score"))
    # else localities named by a whole part (2) or by its beginning or end (1); the best few are kept
    rest = spelled.where(no_code)
    parts = rest.select("u", F.explode("areas").alias("area"))
    whole = parts.select("u", "area", F.lit(2.0).alias("score"))
    windows = F.expr("flatten(transform(sequence(1, size(w) - 1), i -> array(array_join(slice(w, 1, i), ' '), array_join(slice(w, -i, i), ' '))))")
    partly = parts.withColumn("w", F.split("area", " ")).where("size(w) > 1").select("u", F.explode(windows).alias("area")).withColumn("score", F.lit(1.0) + F.least(F.length("area"), F.lit(90)) / 100)
    guesses = whole.union(partly).join(areas, "area").select("u", F.col("canon").alias("place"), "score").join(place_of.select("place").distinct(), "place", "left_semi")
    guesses = guesses.groupBy("u", "place").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(W.partitionBy("u").orderBy(F.desc("score"), "place"))).where(f"r <= {BEAM}").drop("r")
    beam = scratch.cut(rest.select(*kept).join(guesses, "u", "left"))
    known = scratch.cut(sure.union(beam.where("place is not null").select(*kept, "place", "score")))

    # how often a street is spelled so anywhere tells spellings from slips even where a locality has it just twice
    streets = scratch.cut(known.groupBy("place", "kind", "street").agg(F.sum(F.when(F.col("bare"), 0).otherwise(F.col("k"))).alias("k")))
    anywhere = scratch.cut(streets.groupBy("street", "kind").agg(F.sum("k").alias("n")))
    canon = scratch.cut(_cluster(streets.drop("k").join(anywhere, ["street", "kind"]), "street", ("place", "kind")))
    # a street without its kind is that of its name, if the locality has but one of that name
    only = canon.where("street = canon and kind <> ''").groupBy("place", "street").agg(F.count(F.lit(1)).alias("m"), F.first("kind").alias("full")).where("m = 1").drop("m")
    full = canon.where("kind <> ''").select("place", "kind", "street", "canon", F.col("kind").alias("full"), "n").union(canon.where("kind = ''").join(only, ["place", "street"], "left").select("place", "kind", "street", F.col("street").alias("canon"), F.coalesce("full", F.lit("")), "n"))
    lookup = scratch.cut(full.withColumn("entry", F.xxhash64("place", "canon", "full")))
    entries = lookup.groupBy("entry").agg(F.first("place").alias("place"), F.first("canon").alias("street"), F.first("full").alias("kind"))
    found = known.join(lookup, ["place", "kind", "street"]).select("u", "entry", "score", F.col("n") > 1)
    found = found.toDF("u", "entry", "score", "seen").withColumn("score", F.col("score") + F.when(F.col("seen"), 1).otherwise(0))
    # several equally good hypotheses stay, a worse one goes; spellings with a postcode have but one
    top = found.groupBy("u").agg(F.max("score").alias("top"))
    chosen = scratch.cut(found.join(top, "u").where("score = top").select("u", "entry"))
    found = scratch.cut(_compact(rows).join(chosen, "u").drop("u"))
    scratch.release()

    # what is left of slips: streets somewhat alike at one number of one postcode are one entry, under its commonest spelling
    spot = ["postcode", "number"]
    doubt = found.where("postcode <> 0").groupBy(*spot).agg(F.min("entry").alias("x"), F.max("entry").alias("y")).where("x <> y").select(*spot)
    at = scratch.cut(found.join(doubt, spot, "left_semi").select(*spot, "entry").distinct().join(entries, "entry").join(anywhere, ["street", "kind"], "left").fillna(0, ["n"]))
    named = lambda x: at.select(*spot, F.concat_ws(" ", "street", "kind").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("street", "kind", "n", "entry", "place")])
    alike = named("b").join(named("a"), spot).where("a <> b and (n_a > n_b or n_a = n_b and a < b)").withColumn("d", F.levenshtein("a", "b"))
    alike = alike.where((F.col("d") <= F.lit(LIKENESS) * F.least(F.length("a"), F.length("b"))) | (F.col("street_a") == F.col("street_b")) & ((F.col("kind_a") == "") | (F.col("kind_b") == "")))
    best = alike.groupBy(*spot, F.col("entry_b").alias("entry")).agg(F.max(F.struct("n_a", (-F.col("d")).alias("e"), "street_a", "kind_a", "place_b")).alias("x"))
    best = scratch.cut(best.select(*spot, "entry", F.xxhash64("x.place_b", "x.street_a", "x.kind_a").alias("other")))
    found = found.join(best, [*spot, "entry"], "left").select("side", "id", "raw", F.coalesce("other", "entry").alias("entry"), *spot, "compass")

    # no locality at all: street and number that occur in one place only
    lost = beam.where("place is null").select("u", "street", "kind")
    homes = lost.join(entries, ["street", "kind"]).select("u", "entry", "place")
    where = scratch.cut(_compact(rows.join(lost.select("u").distinct(), "u", "left_semi")))
    maybe = where.select("u", "number").distinct().join(homes, "u")
    there = found.select("entry", "number").distinct()
    once = maybe.join(there, ["entry", "number"], "left_semi").groupBy("u", "number").agg(F.countDistinct("place").alias("m"), F.first("entry").alias("entry")).where("m = 1").drop("m")
    return found.union(where.join(once, ["u", "number"]).select(*found.columns))


def same_location(left: DataFrame, right: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id_a, id_b) of the records of left(id, address) and right(id, address) whose addresses differ as strings and denote
    one location. Null and empty addresses, and those without number or street, denote none; a record delivered twice
    counts once."""
    scratch = scratch or Scratch(left.sparkSession, "gazetteer")
    tag = lambda d, x: d.select(F.lit(x).alias("side"), "id", "address").where("id is not null and trim(address) <> ''")
    read = scratch.cut(read_addresses(tag(left, "a").union(tag(right, "b"))))
    spot = scratch.cut(resolve(read, scratch))
    part = lambda x: spot.where(F.col("side") == x).select(F.xxhash64("entry", "number").alias("k"), F.col("id").alias(f"id_{x}"), F.col("raw").alias(f"r{x}"), F.col("postcode").alias(f"p{x}"), F.col("compass").alias(f"c{x}"))
    pairs = part("a").join(part("b"), "k")
    agree = lambda x, y, none: (F.col(x) == F.col(y)) | (F.col(x) == none) | (F.col(y) == none)
    return pairs.where((F.col("ra") != F.col("rb")) & agree("pa", "pb", 0) & agree("ca", "cb", "")).select("id_a", "id_b").distinct()
