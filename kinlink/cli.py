"""Command line: match, train, predict, evaluate, audit, validate over tab-separated files."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.errors import PySparkException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.operators import evaluate as E
from kinlink.operators import validate as V
from kinlink.operators.retrieval import LIMIT, normalized
from kinlink.operators.rules import one_each
from kinlink.plans import model as M
from kinlink.plans import pipelines as P
from kinlink.ship import ship
from kinlink.sources import manifest, tables


def _records(spark: SparkSession, folder: str, split: str) -> tuple[DataFrame, DataFrame]:
    read = lambda i: tables.read_quoted(spark, f"{folder}/{split}_source{i}.tsv", i)
    return read(1), read(2).unionByName(read(3))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.csv(f"{folder}/train_ground_truth.tsv", sep="\t", header=True).na.fill("").select("source1_entity_id", "matched_entity_ids")


RESULTS = (("candidate_pairs", "candidate_entity_ids"), ("matching_results", "matched_entity_ids"))


def match(spark, a) -> int:
    sources, targets = _records(spark, a.folder, a.split)
    lists = P.rule_matches(sources, targets, a.candidates).cache()
    for name, column in (("candidate_pairs", "candidate_entity_ids"), ("matching_results", "matched_entity_ids")):
        tables.write_ordered(one_each(sources), lists, f"{a.out}/{name}", column)
    return 0


def train(spark, a) -> int:
    sources, targets = _records(spark, a.folder, "train")
    labels = _labels(spark, a.folder)
    sample = E.hash_sample(one_each(sources), "entity_id", a.entities, a.seed)
    featured = P.retrieved_features(sample, targets, a.limit).cache()
    labels = labels.join(sample.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    model, scored = M.trained(featured, labels, a.trees, a.seed)
    model.write().overwrite().save(f"{a.model}/trees")
    M.report_of(scored, featured, labels, a.trees, a.seed).withColumn("candidate_limit", F.lit(a.limit)).coalesce(1).write.mode("overwrite").json(f"{a.model}/meta")
    return 0


def predict(spark, a) -> int:
    meta = spark.read.json(f"{a.model}/meta").first()
    if meta.normalizer_version != M.NORMALIZER_VERSION:
        raise ValueError("the model was made with another normalizer")
    sources, targets = _records(spark, a.folder, "test")
    done = ()
    if a.resume and all(tables.exists(spark, f"{a.out}/{n}") for n, _ in RESULTS):
        done = manifest.reconciled(*[tables.read_results(spark, f"{a.out}/{n}", c) for n, c in RESULTS])
        sources = manifest.remaining(sources, done[0])
    threshold = meta.threshold if a.threshold is None else a.threshold
    lists = P.predicted_lists(sources, targets, PipelineModel.load(f"{a.model}/trees"), threshold, a.limit or meta.candidate_limit)
    lists = lists.cache()
    for i, (name, column) in enumerate(RESULTS):
        if done:  # rows whose source a stopped run left in one file only are made again
            kept = done[i].select("source1_entity_id", column).cache()
            kept.count()  # before either file is replaced
    for i, (name, column) in enumerate(RESULTS):
        path, mine = f"{a.out}/{name}", lists.select("source1_entity_id", column)
        tables.replace_lists(mine.union(done[i].select("source1_entity_id", column)), path, column) if done else tables.write_lists(mine, path, column)
    return 0


def evaluate(spark, a) -> int:
    sources, targets = _records(spark, a.folder, "train")
    labels = _labels(spark, a.folder)
    held = E.holdout(E.hash_sample(one_each(sources), "entity_id", a.entities), "entity_id").where("held_out")
    labels = labels.join(held.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    featured = P.retrieved_features(held, targets, a.limit)
    scored = M.probabilities(PipelineModel.load(f"{a.model}/trees"), featured).cache()
    one, two = E.global_grid(spark, 20, 90, 1), E.source_grid(spark, 20, 90, 5)
    report = {
        "recall": E.candidate_recall(scored, labels).first().asDict(),
        "global": E.best_policy(E.sweep(scored, labels, one)).first().asDict(),
        "per_source": E.best_policy(E.sweep(scored, labels, two)).first().asDict(),
        "fixed": [r.asDict() for r in E.sweep(scored, labels, E.fixed_grid(spark, True)).collect()],
        "folds": [r.asDict() for r in E.policies_cross_validated(scored, labels, {"global": one, "per_source": two, "fixed": E.fixed_grid(spark)}).collect()],
    }
    print(json.dumps(report, indent=2))
    return 0


def audit(spark, a) -> int:
    sources, targets = _records(spark, a.folder, "train")
    sample = E.hash_sample(one_each(sources), "entity_id", a.entities, a.seed)
    labels = _labels(spark, a.folder).join(sample.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    found = P.retrieved_features(sample, targets, a.limit).select("source_id", "target_id").cache()
    s, t = normalized(sample), one_each(normalized(targets))
    print(json.dumps(E.candidate_recall(found, labels).first().asDict() | E.miss_audit(found, labels, s, t).first().asDict()))
    for r in E.missed(found, labels).orderBy("source_id", "target_id").limit(a.examples).collect():
        print(r.source_id, r.target_id)
    return 0


def validate(spark, a) -> int:
    source = f"{a.folder}/test_source1.tsv"
    if not tables.exists(spark, source):
        print(f"error: test_source1: file_missing: 1, such as {source}")
        return 1
    required = tables.read_ids(spark, source)
    # rows without a tab are findings of their own and no lists
    read = lambda p, c: tables.read_lists(spark, p).where("list is not null").select("line", F.col("id").alias("source1_entity_id"), F.col("list").alias(c))
    targets = None
    lists, findings = {}, []
    if a.check_ids:
        files = [f"{a.folder}/test_source{i}.tsv" for i in (2, 3)]
        if lacking := [f for f in files if not tables.exists(spark, f)]:
            findings.append(V.one_finding(spark, "targets", "targets_missing", " ".join(lacking)))
        else:
            targets = tables.read_ids(spark, files[0]).union(tables.read_ids(spark, files[1]))
    else:
        findings.append(V.one_finding(spark, "targets", "ids_unchecked"))
    for file, path, column in (("matching_results", a.matches, "matched_entity_ids"), ("candidate_pairs", a.candidates, "candidate_entity_ids")):
        if path and not tables.exists(spark, path):
            findings.append(V.one_finding(spark, file, "file_missing" if file == "matching_results" else "candidates_missing", path))
        elif path:
            wrong, readable = V.malformed(tables.read_lines(spark, path), file, column)
            findings.append(wrong)
            if readable:
                lists[file] = read(path, column)
                n = V.list_counts(lists[file], column).first()
                print(f"{file}: {n['rows']} rows, {n['empty']} empty, {n['non_empty']} non-empty")
    if lists:
        findings.append(V.all_findings(lists.get("matching_results"), lists.get("candidate_pairs"), required, targets).select("file", "severity", "check", "subject"))
    every = findings[0]
    for f in findings[1:]:
        every = every.union(f)
    found = V.summary(every).collect()
    for r in found:
        print(f"{r.severity}: {r.file}: {r.check}: {r.n}, such as {r.examples}")
    return int(any(r.severity == "error" for r in found))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinlink")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, **options):
        p = sub.add_parser(f.__name__)
        p.set_defaults(run=f)
        p.add_argument("folder")
        for name, value in options.items():
            flag = "--" + name.replace("_", "-")
            if isinstance(value, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=value if not isinstance(value, type) else None, type=value if isinstance(value, type) else type(value))

    command(match, out="out", split="test", candidates=8)
    command(train, model="model", entities=8000, limit=LIMIT, trees=M.ROUNDS, seed=M.SEED)
    command(predict, model="model", out="out", limit=int, threshold=float, resume=False)
    command(evaluate, model="model", entities=20000, limit=250)
    command(audit, entities=2000, limit=LIMIT, seed=919, examples=25)
    command(validate, matches="matching_results.tsv", candidates=str, check_ids=False)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(ship(SparkSession.builder.appName("kinlink").getOrCreate()), args)
    except (ValueError, RuntimeError, OSError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
