"""The queries of the core operators over the test tables, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinlink import oracle as O
from kinlink.operators import evaluate as E
from kinlink.operators import features as X
from kinlink.operators import retrieval as R
from kinlink.operators import rules as A
from kinlink.operators import validate as V
from kinlink.plans import model as M
from kinlink.scratch import Scratch
from kinlink.ship import ship
from kinlink.sources import manifest
from kinlink.sources.manifest import signature_of_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _sources(spark, d) -> DataFrame:
    return A.one_each(table(spark, d, "train_source1"))


def _targets(spark, d) -> DataFrame:
    return table(spark, d, "train_source2").unionByName(table(spark, d, "train_source3"))


def query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _long(c: str):
    return F.col(c).cast("bigint").alias(c)


_joined = lambda c: F.array_join(F.array_sort(c), " ").alias(c)
_sorted = lambda c: f"array_to_string(list_sort({c}), ' ') AS {c}"


# ---- rule matcher
def _a(spark, d):
    return A.prepared(_sources(spark, d), True), A.prepared(_targets(spark, d), False)


def _stored(spark, d):
    """Both sides prepared once, for plans that read them several times."""
    scratch = Scratch(spark, "rules")
    return tuple(scratch.cut(x) for x in _a(spark, d))


@query(f"{O.A} SELECT entity_id, src, rid, canonical_name, {_sorted('name_set')}, {_sorted('address_set')}, {_sorted('digits')}, name_run FROM t")
def prepared_a(spark, d):
    return _a(spark, d)[1].select("entity_id", "src", "rid", "canonical_name", _joined("name_set"), _joined("address_set"), _joined("digits"), "name_run")


@query(f"{O.A} SELECT entity_id, canonical_name, {_sorted('address_set')} FROM s")
def prepared_sources_a(spark, d):
    return _a(spark, d)[0].select("entity_id", "canonical_name", _joined("address_set"))


@query("SELECT coalesce(country, '') AS country, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM train_source1 GROUP BY 1")
def country_counts(spark, d):
    s = table(spark, d, "train_source1").groupBy(F.coalesce("country", F.lit("")).alias("country")).agg(F.count(F.lit(1)).alias("n"))
    return s.crossJoin(s.agg(F.sum("n").alias("_all"))).select("country", "n", F.round(100.0 * F.col("n") / F.col("_all"), 6).alias("share"))


@query("SELECT coalesce(country, '') AS country, src, count(*) AS n FROM (SELECT * FROM train_source2 UNION ALL SELECT * FROM train_source3) GROUP BY 1, 2")
def source_counts(spark, d):
    return _targets(spark, d).groupBy(F.coalesce("country", F.lit("")).alias("country"), "src").agg(F.count(F.lit(1)).alias("n"))


@query(f"{O.A} SELECT country, key, count(*) AS n FROM word_post GROUP BY 1, 2")
def posting_counts(spark, d):
    return A.postings(_a(spark, d)[1], "name_set", A.SHORTEST_RARE).groupBy("country", "key").agg(F.count(F.lit(1)).alias("n"))


@query(f"{O.A} SELECT country, key, n FROM rare_digit")
def rare_keys(spark, d):
    return A.rare(A.postings(_a(spark, d)[1], "digits"))


@query(f"{O.A} SELECT source_id, target_id FROM by_name")
def block_exact_name(spark, d):
    return A.block_exact(*_a(spark, d))


@query(f"{O.A} SELECT source_id, target_id FROM by_word")
def block_rare_word(spark, d):
    return A.block_rare_word(*_a(spark, d))


@query(f"{O.A} SELECT source_id, target_id FROM by_digit")
def block_digit_address(spark, d):
    return A.block_digit(*_a(spark, d))


@query(f"{O.A} SELECT source_id, target_id FROM cand")
def candidates_union(spark, d):
    return A.candidates(*_stored(spark, d))


def _judged(spark, d):
    s, t = _stored(spark, d)
    return s, A.judged(A.candidates(s, t), s, A.one_each(t))


@query(f"{O.A} SELECT source_id, target_id, rule::INT AS rule, matched, round(score, 6) AS score FROM judged")
def rule_cascade(spark, d):
    return _judged(spark, d)[1].withColumn("score", F.round("score", 6))


@query(f"{O.A} SELECT source_id, target_id, rank::INT AS rank, matched FROM ranked")
def topk_candidates(spark, d):
    return A.best(_judged(spark, d)[1]).select("source_id", "target_id", "rank", "matched")


@query(f"{O.A} SELECT source_id, target_id FROM ranked WHERE matched")
def matches_a(spark, d):
    return A.best(_judged(spark, d)[1]).where("matched").select("source_id", "target_id")


@query(f"{O.A} SELECT s.entity_id AS source1_entity_id, coalesce(string_agg(target_id, ',' ORDER BY rank), '') AS candidate_entity_ids, coalesce(string_agg(target_id, ',' ORDER BY rank) FILTER (WHERE matched), '') AS matched_entity_ids FROM s LEFT JOIN ranked r ON r.source_id = s.entity_id GROUP BY 1")
def output_lists(spark, d):
    s, judged = _judged(spark, d)
    return A.output_lists(s, A.best(judged))


@query(f"{O.A}, per AS (SELECT s.country, s.entity_id, count(r.target_id) AS c, count(*) FILTER (WHERE r.matched) AS m FROM s LEFT JOIN ranked r ON r.source_id = s.entity_id GROUP BY 1, 2) SELECT country, count(*) AS entities, round(avg(c), 6) AS candidates, round(avg(m), 6) AS matches FROM per GROUP BY 1")
def averages_by_country(spark, d):
    s, judged = _judged(spark, d)
    n = A.best(judged).groupBy("source_id").agg(F.count(F.lit(1)).alias("c"), F.count_if("matched").alias("m"))
    per = s.select("country", F.col("entity_id").alias("source_id")).join(n, "source_id", "left").fillna(0)
    return per.groupBy("country").agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("c"), 6).alias("candidates"), F.round(F.avg("m"), 6).alias("matches"))


# ---- retrieval and features
def _b(spark, d):
    return R.normalized(_sources(spark, d)), R.normalized(_targets(spark, d))


@query(f"{O.B0} SELECT entity_id, src, rid, name, address FROM t")
def normalized_b(spark, d):
    return _b(spark, d)[1].select("entity_id", "src", "rid", "name", "address")


@query(f"{O.B0} SELECT entity_id, array_to_string(list_sort({O._triples('name')}), '|') AS triples FROM s")
def trigrams(spark, d):
    from kinlink.functions.text import trigrams as triples

    return _b(spark, d)[0].select("entity_id", F.array_join(F.array_sort(triples(F.col("name"))), "|").alias("triples"))


@query(f"{O.B} SELECT source_id, q::INT AS q, budget::INT AS budget, coalesce(phrase, '') AS phrase, array_to_string(n, ' ') AS names, array_to_string(a, ' ') AS places FROM asked")
def retrieval_queries(spark, d):
    of = lambda f: F.array_join(F.transform(F.filter("terms", lambda t: t["field"] == f), lambda t: t["term"]), " ")
    return R.queries(_b(spark, d)[0]).select("source_id", "q", "budget", F.coalesce("phrase", F.lit("")).alias("phrase"), of("name").alias("names"), of("address").alias("places"))


@query(f"{O.B} SELECT country, CASE field WHEN 'n' THEN 'name' ELSE 'address' END AS field, term, count(*) AS n FROM posted WHERE country <> '' GROUP BY ALL")
def index_postings(spark, d):
    return R.index(_b(spark, d)[1]).groupBy("country", "field", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"{O.B} SELECT source_id, q::INT AS q, ord FROM hits")
def retrieval_budgeted(spark, d):
    s, t = _stored_b(spark, d)
    return R.hits(R.queries(s), R.index(t), t)


@query(f"{O.B} SELECT source_id, target_id, rank::INT AS rank FROM merged")
def retrieval_capped(spark, d):
    return R.retrieve(*_stored_b(spark, d))


def _stored_b(spark, d):
    scratch = Scratch(spark, "retrieval")
    return tuple(scratch.cut(x) for x in _b(spark, d))


def _listed(spark, d):
    """Candidates of the earlier run."""
    lists = table(spark, d, "candidate_pairs").select(F.col("source1_entity_id").alias("source_id"), F.explode(F.split(F.coalesce("candidate_entity_ids", F.lit("")), ",")).alias("target_id"))
    return lists.where("target_id <> ''").distinct()


def _sides(spark, d):
    s, t = _b(spark, d)
    return s, A.one_each(t)


@query(f"{O.FEATURED} SELECT source_id, target_id, {O.FEATURE_COLUMNS} FROM listed JOIN ca a ON a.entity_id = source_id JOIN cb b ON b.entity_id = target_id")
def pair_features_sets(spark, d):
    f = X.set_features(_listed(spark, d), *_sides(spark, d))
    return f.select("source_id", "target_id", *[F.round(c, 6).alias(c) for c in X.NAMES if c not in X.SEQUENCE])


@query()
def pair_features_all(spark, d):
    return X.all_features(_listed(spark, d), *_sides(spark, d))


# ---- labels and evaluation
def _labels(spark, d):
    return table(spark, d, "train_labels")


@query(f"WITH {O.LABELS}, {O.LISTED} SELECT l.source_id, l.target_id, CASE WHEN t.target_id IS NULL THEN 0 ELSE 1 END::INT AS label FROM listed l LEFT JOIN truth t USING (source_id, target_id) WHERE l.source_id IN (SELECT source_id FROM labelled)")
def label_join(spark, d):
    return E.with_labels(_listed(spark, d), _labels(spark, d))


@query("SELECT DISTINCT entity_id, (('0x' || substr(sha256(entity_id), 1, 4))::INT % 5 = 0) AS held_out FROM train_source1")
def holdout_split(spark, d):
    return E.holdout(table(spark, d, "train_source1").select("entity_id").distinct(), "entity_id")


@query(f"WITH {O.LABELS}, {O.LISTED}, h AS (SELECT count(*) AS actual, count(l.target_id) AS hits FROM truth t LEFT JOIN listed l USING (source_id, target_id)) SELECT hits, actual, round(CASE WHEN actual > 0 THEN hits::DOUBLE / actual ELSE 0 END, 6) AS recall FROM h")
def candidate_recall(spark, d):
    return E.candidate_recall(_listed(spark, d), _labels(spark, d)).withColumn("recall", F.round("recall", 6))


def _earlier_matches(spark, d):
    lists = table(spark, d, "matching_results").select(F.trim("source1_entity_id").alias("source_id"), F.explode(F.split(F.coalesce("matched_entity_ids", F.lit("")), ",")).alias("target_id"))
    return lists.select("source_id", F.trim("target_id").alias("target_id")).where("target_id <> '' and source_id <> ''").distinct()


_PREDICTED = "predicted AS (SELECT DISTINCT trim(source1_entity_id) AS source_id, trim(v) AS target_id FROM (SELECT source1_entity_id, unnest(string_split(coalesce(matched_entity_ids, ''), ',')) AS v FROM matching_results) WHERE trim(v) <> '' AND trim(source1_entity_id) <> '')"
_ENTITY = f"""WITH {O.LABELS}, {_PREDICTED}, n AS (SELECT l.source_id, (SELECT count(*) FROM truth t WHERE t.source_id = l.source_id) AS actual, (SELECT count(*) FROM predicted p WHERE p.source_id = l.source_id) AS predicted,
  (SELECT count(*) FROM predicted p JOIN truth t USING (source_id, target_id) WHERE p.source_id = l.source_id) AS hit FROM labelled l),
e AS (SELECT *, CASE WHEN actual = 0 THEN CASE WHEN predicted = 0 THEN 1.0 ELSE 0.0 END WHEN predicted = 0 OR hit = 0 THEN 0.0 ELSE 1.25 * hit / (0.25 * actual + predicted) END::DOUBLE AS f05 FROM n)"""


@query(f"{_ENTITY} SELECT source_id, actual, predicted, hit, round(f05, 6) AS f05 FROM e")
def entity_f05(spark, d):
    return E.entity_scores(_earlier_matches(spark, d), _labels(spark, d)).withColumn("f05", F.round("f05", 6))


@query(f"{_ENTITY} SELECT count(*) AS entities, round(avg(f05), 6) AS macro_f05 FROM e")
def macro_f05(spark, d):
    return E.entity_scores(_earlier_matches(spark, d), _labels(spark, d)).agg(F.count(F.lit(1)).alias("entities"), F.round(F.avg("f05"), 6).alias("macro_f05"))


def _scored(spark, d):
    f = X.set_features(_listed(spark, d), *_sides(spark, d))
    return f.select("source_id", "target_id", ((F.col("name_trigram_jaccard") + F.col("address_containment")) / 2).alias("p"), (F.col("is_source2") > 0).alias("is_source2"))


_GRID = "SELECT x / 100.0::DOUBLE AS t2, x / 100.0::DOUBLE AS t3 FROM range({}, {}, {}) r(x)"
_GRID2 = "SELECT a.x / 100.0::DOUBLE AS t2, b.x / 100.0::DOUBLE AS t3 FROM range(20, 91, 5) a(x), range(20, 91, 5) b(x)"
_BEST = "SELECT t2, t3, entities, round(f05, 6) AS f05 FROM swept ORDER BY round(f05, 12) DESC, t2, t3 LIMIT 1"


def _rounded(df):
    return df.withColumn("f05", F.round("f05", 6))


@query(f"{O.sweep_sql(_GRID.format(10, 95, 2))} SELECT t2, t3, entities, round(f05, 6) AS f05 FROM swept")
def threshold_sweep(spark, d):
    return _rounded(E.sweep(_scored(spark, d), _labels(spark, d), E.global_grid(spark, 10, 94, 2)))


@query(f"{O.sweep_sql(_GRID.format(20, 91, 1))} {_BEST}")
def global_policy(spark, d):
    return _rounded(E.best_policy(E.sweep(_scored(spark, d), _labels(spark, d), E.global_grid(spark, 20, 90, 1))))


@query(f"{O.sweep_sql(_GRID2)} {_BEST}")
def per_source_policy(spark, d):
    return _rounded(E.best_policy(E.sweep(_scored(spark, d), _labels(spark, d), E.source_grid(spark, 20, 90, 5))))


@query(f"{O.sweep_sql('SELECT * FROM (VALUES (0.52::DOUBLE, 0.52::DOUBLE), (0.5, 0.7)) v(t2, t3)')} SELECT t2, t3, entities, round(f05, 6) AS f05 FROM swept")
def fixed_policies(spark, d):
    grid = spark.createDataFrame([(0.52, 0.52), (0.50, 0.70)], "t2 double, t3 double")
    return _rounded(E.sweep(_scored(spark, d), _labels(spark, d), grid))


def _fold_sql(policy: str, grid: str) -> str:
    tuned = "tuned AS (SELECT * FROM swept QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(f05, 12) DESC, t2, t3) = 1)"
    return f"{O.sweep_sql(grid, fold=True)}, {tuned} SELECT '{policy}' AS policy, t.fold, t.t2, t.t3, round(t.f05, 6) AS tuned, round(o.f05, 6) AS f05 FROM tuned t JOIN swept o ON o.fold = 1 - t.fold AND o.t2 = t.t2 AND o.t3 = t.t3"


_FOLDS = {"global": _GRID.format(20, 91, 1), "per_source": _GRID2, "fixed": "SELECT 0.5::DOUBLE AS t2, 0.7::DOUBLE AS t3"}


@query(" UNION ALL ".join(f"SELECT * FROM ({_fold_sql(p, g)})" for p, g in _FOLDS.items()))
def policy_cv(spark, d):
    grids = {"global": E.global_grid(spark, 20, 90, 1), "per_source": E.source_grid(spark, 20, 90, 5), "fixed": E.fixed_grid(spark)}
    return _rounded(E.policies_cross_validated(_scored(spark, d), _labels(spark, d), grids)).withColumn("tuned", F.round("tuned", 6))


@query(f"""{O.FEATURED}, miss AS (SELECT * FROM truth ANTI JOIN listed USING (source_id, target_id)), f AS (SELECT {", ".join(f"{v} AS {k}" for k, v in O.SET_FEATURES.items())} FROM miss JOIN ca a ON a.entity_id = source_id JOIN cb b ON b.entity_id = target_id)
SELECT count(*) AS missed, count(*) FILTER (name_jaccard > 0) AS name_words, count(*) FILTER (name_trigram_jaccard > 0) AS name_triples, count(*) FILTER (address_jaccard > 0) AS address_words, count(*) FILTER (exact_digit_overlap > 0) AS digits, count(*) FILTER (exact_name > 0) AS exact_name, count(*) FILTER (exact_address > 0) AS exact_address FROM f""")
def miss_audit(spark, d):
    return E.miss_audit(_listed(spark, d), _labels(spark, d), *_sides(spark, d))


@query("SELECT DISTINCT entity_id FROM train_source1 ORDER BY sha256('2026:' || entity_id), entity_id LIMIT 500")
def hash_sample(spark, d):
    return E.hash_sample(table(spark, d, "train_source1").select("entity_id").distinct(), "entity_id", 500)


@query(f"WITH {O.LABELS}, {O.LISTED} SELECT coalesce(sum(CASE WHEN t.target_id IS NULL THEN 0 ELSE 1 END), 0)::BIGINT AS positive, count(*) AS pairs FROM listed l LEFT JOIN truth t USING (source_id, target_id) WHERE l.source_id IN (SELECT source_id FROM labelled)")
def class_counts(spark, d):
    return E.with_labels(_listed(spark, d), _labels(spark, d)).agg(F.coalesce(F.sum("label"), F.lit(0)).alias("positive"), F.count(F.lit(1)).alias("pairs"))


# ---- checks of result lists
def _results(spark, d):
    return table(spark, d, "matching_results"), table(spark, d, "candidate_pairs")


def _elements(t: str, c: str) -> str:
    return f"(SELECT source1_entity_id AS s, unnest(CASE WHEN trim(coalesce({c}, '')) = '' THEN [] ELSE string_split({c}, ',') END) AS e FROM {t})"


_M, _C = _elements("matching_results", "matched_entity_ids"), _elements("candidate_pairs", "candidate_entity_ids")
_SUBJECT = "concat_ws(':', s, e) AS subject"


@query("SELECT 'duplicate_row' AS \"check\", coalesce(source1_entity_id, '') AS subject FROM matching_results GROUP BY source1_entity_id HAVING count(*) > 1")
def duplicate_rows(spark, d):
    return V.duplicate_rows(_results(spark, d)[0])


@query("SELECT DISTINCT 'repeated_id' AS \"check\", coalesce(source1_entity_id, '') AS subject FROM matching_results WHERE trim(coalesce(matched_entity_ids, '')) <> '' AND len(string_split(matched_entity_ids, ',')) <> len(list_distinct(string_split(matched_entity_ids, ',')))")
def intra_list_duplicates(spark, d):
    return V.repeated_elements(_results(spark, d)[0], "matched_entity_ids")


@query(f"SELECT DISTINCT 'self_match' AS \"check\", {_SUBJECT} FROM {_M} WHERE starts_with(e, 'S1-')")
def self_matches(spark, d):
    return V.self_matches(_results(spark, d)[0], "matched_entity_ids")


@query(f"SELECT DISTINCT 'foreign_id' AS \"check\", {_SUBJECT} FROM {_M} WHERE NOT (starts_with(e, 'S1-') OR starts_with(e, 'S2-') OR starts_with(e, 'S3-'))")
def prefix_violations(spark, d):
    return V.foreign_ids(_results(spark, d)[0], "matched_entity_ids")


@query(f"SELECT DISTINCT 'unknown_id' AS \"check\", {_SUBJECT} FROM {_M} WHERE (starts_with(e, 'S2-') OR starts_with(e, 'S3-')) AND e NOT IN (SELECT entity_id FROM train_source2)")
def unknown_ids(spark, d):
    """Against the second source alone, so that there are some: those of the third are unknown to it."""
    return V.unknown_ids(_results(spark, d)[0], "matched_entity_ids", table(spark, d, "train_source2"))


@query("SELECT DISTINCT 'missing_source' AS \"check\", entity_id AS subject FROM train_source1 ANTI JOIN matching_results ON entity_id = source1_entity_id")
def missing_required(spark, d):
    return V.missing_sources(_results(spark, d)[0], table(spark, d, "train_source1"))


@query("SELECT DISTINCT 'extra_source' AS \"check\", coalesce(source1_entity_id, '') AS subject FROM matching_results ANTI JOIN (SELECT entity_id FROM train_source1 WHERE country = 'US') ON entity_id = source1_entity_id")
def extra_sources(spark, d):
    """Where only the sources of one country are asked for, so that there are some."""
    return V.extra_sources(_results(spark, d)[0], table(spark, d, "train_source1").where("country = 'US'"))


def _last_rows(t: str, c: str) -> str:
    """The SQL of the last row of each source, rows being in the order of their lists."""
    return f"(SELECT * FROM {t} QUALIFY row_number() OVER (PARTITION BY source1_entity_id ORDER BY coalesce({c}, '') DESC) = 1)"


_LAST_M, _LAST_C = _elements(_last_rows("matching_results", "matched_entity_ids"), "matched_entity_ids"), _elements(_last_rows("candidate_pairs", "candidate_entity_ids"), "candidate_entity_ids")


@query(f"SELECT DISTINCT 'match_not_candidate' AS \"check\", coalesce(s, '') AS subject FROM {_LAST_M} m WHERE NOT EXISTS (SELECT 1 FROM {_LAST_C} c WHERE c.s = m.s AND c.e = m.e)")
def match_not_candidate(spark, d):
    """Rows of a source are in the order of their lists here, as a table has no lines."""
    w = lambda c: W.partitionBy("source1_entity_id").orderBy(F.coalesce(c, F.lit("")))
    m, c = (t.withColumn("line", F.row_number().over(w(x))) for t, x in zip(_results(spark, d), ("matched_entity_ids", "candidate_entity_ids"), strict=True))
    return V.unmatched_candidates(m, c)


@query("SELECT count(*) AS rows, count(*) FILTER (trim(coalesce(matched_entity_ids, '')) = '') AS empty, count(*) FILTER (trim(coalesce(matched_entity_ids, '')) <> '') AS non_empty FROM matching_results")
def list_counts(spark, d):
    return V.list_counts(_results(spark, d)[0], "matched_entity_ids")


def _summary_sql() -> str:
    checks = [ORACLE_SQL[n] for n in ("duplicate_rows", "intra_list_duplicates", "self_matches", "prefix_violations")]
    checks.append(f"SELECT DISTINCT 'unknown_id' AS \"check\", {_SUBJECT} FROM {_M} WHERE (starts_with(e, 'S2-') OR starts_with(e, 'S3-')) AND e NOT IN (SELECT entity_id FROM train_source2 UNION SELECT entity_id FROM train_source3)")
    checks.append(ORACLE_SQL["missing_required"])
    checks.append("SELECT DISTINCT 'extra_source' AS \"check\", coalesce(source1_entity_id, '') AS subject FROM matching_results ANTI JOIN train_source1 ON entity_id = source1_entity_id")
    other = lambda q: q.replace("matching_results", "candidate_pairs").replace("matched_entity_ids", "candidate_entity_ids")
    rows = [f"SELECT '{f}' AS file, \"check\", subject FROM ({q})" for c in checks for f, q in (("matching_results", c), ("candidate_pairs", other(c)))]
    rows.append(f"SELECT DISTINCT 'matching_results', 'match_not_candidate', coalesce(s, '') FROM {_M} m WHERE NOT EXISTS (SELECT 1 FROM {_C} c WHERE c.s = m.s AND c.e = m.e)")
    return f"""SELECT file, CASE WHEN "check" = 'match_not_candidate' THEN 'warning' ELSE 'error' END AS severity, "check", count(*) AS n,
        array_to_string(list_slice(list_sort(list(subject)), 1, 5), ' ') AS examples FROM ({" UNION ALL ".join(rows)}) GROUP BY file, "check" """


@query(_summary_sql())
def validation_summary(spark, d):
    return V.summary(V.all_findings(*_results(spark, d), table(spark, d, "train_source1"), _targets(spark, d)))


@query("SELECT DISTINCT entity_id, business_name, business_address, country FROM train_source1 ANTI JOIN matching_results ON entity_id = trim(source1_entity_id)")
def resume_anti_join(spark, d):
    done = table(spark, d, "matching_results").select(F.trim("source1_entity_id").alias("entity_id"))
    return table(spark, d, "train_source1").select("entity_id", "business_name", "business_address", "country").distinct().join(done, "entity_id", "left_anti")


@query("""SELECT 'candidate_pairs' AS file, source1_entity_id, candidate_entity_ids AS list FROM candidate_pairs WHERE source1_entity_id IN (SELECT source1_entity_id FROM matching_results)
UNION ALL SELECT 'matching_results', source1_entity_id, matched_entity_ids FROM matching_results WHERE source1_entity_id IN (SELECT source1_entity_id FROM candidate_pairs)""")
def resume_reconciled(spark, d):
    """The rows of both files that a run which goes on keeps."""
    m, c = _results(spark, d)
    named = zip(("candidate_pairs", "matching_results"), manifest.reconciled(c, m), ("candidate_entity_ids", "matched_entity_ids"), strict=True)
    one, two = (t.select(F.lit(f).alias("file"), "source1_entity_id", F.col(x).alias("list")) for f, t, x in named)
    return one.union(two)


@query("SELECT NOT EXISTS (SELECT 1 FROM (SELECT source1_entity_id FROM matching_results) m FULL JOIN (SELECT source1_entity_id FROM candidate_pairs) c USING (source1_entity_id) WHERE source1_entity_id IS NOT NULL AND (source1_entity_id NOT IN (SELECT source1_entity_id FROM matching_results WHERE source1_entity_id IS NOT NULL) OR source1_entity_id NOT IN (SELECT source1_entity_id FROM candidate_pairs WHERE source1_entity_id IS NOT NULL))) AS same")
def set_equality(spark, d):
    return manifest.same_sources(*_results(spark, d))


@query("SELECT DISTINCT t.* EXCLUDE (updated_at) FROM (SELECT * FROM train_source2 UNION ALL SELECT * FROM train_source3) t WHERE entity_id IN (SELECT unnest(string_split(matched_entity_ids, ',')) FROM train_labels)")
def key_lookup(spark, d):
    wanted = E.truth(_labels(spark, d)).select(F.col("target_id").alias("entity_id")).distinct()
    return _targets(spark, d).drop("updated_at").join(wanted, "entity_id", "left_semi").distinct()


@query("SELECT src, rid, entity_id, row_number() OVER (ORDER BY rid, src) AS place FROM (SELECT * FROM train_source2 UNION ALL SELECT * FROM train_source3)")
def interleaved_order(spark, d):
    from kinlink.sources.tables import interleaved

    return interleaved(_targets(spark, d))


@query("SELECT sha256(string_agg(name || ':' || n, ',' ORDER BY name)) AS signature FROM (SELECT 'train_source2' AS name, count(*) AS n FROM train_source2 UNION ALL SELECT 'train_source3', count(*) FROM train_source3)")
def index_signature(spark, d):
    return signature_of_rows({n: table(spark, d, n) for n in ("train_source2", "train_source3")})


@query()
def file_signature(spark, d):
    """SHA-256 over names, sizes and times of the files of the other sources, which SQL doesn't see."""
    s = manifest.file_signature(spark, [f"{d}/train_source{i}.parquet" for i in (2, 3)])
    return spark.createDataFrame([(s, len(s))], "signature string, length int")


# ---- classifier
@query()
def classifier_scores(spark, d):
    """Held-out pairs with their probability: trees fitted to the other entities' pairs."""
    return M.trained(X.all_features(_listed(spark, d), *_sides(spark, d)), _labels(spark, d))[1]


@query()
def classifier_report(spark, d):
    return M.report(X.all_features(_listed(spark, d), *_sides(spark, d)), _labels(spark, d))
