import pytest

from kinlink import cli
from kinlink.operators import validate as V
from kinlink.sources import manifest, tables
from kinlink.streaming.resolve import resolve_stream

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def write(path, text):
    path.write_bytes(text.encode("utf-8", "surrogateescape"))
    return str(path)


def test_readers(spark, tmp_path):
    quoted = write(tmp_path / "q.tsv", '﻿' + HEADER + 'S2-1\t"A ""B"" C"\t\tUS\nS2-2\tD\n')
    rows = {r.entity_id: r for r in tables.read_quoted(spark, quoted, 2).collect()}
    assert rows["S2-1"].business_name == 'A "B" C' and rows["S2-1"].business_address == "" and rows["S2-2"].country == "" and rows["S2-1"].rid == 0
    plain = write(tmp_path / "p.tsv", HEADER + 'S2-1\t"A"\tx\tUS\textra\nS2-2\tshort\n')
    rows = tables.read_plain(spark, plain, 2).collect()
    assert [(r.entity_id, r.business_name) for r in rows] == [("S2-1", '"A"')]
    with pytest.raises(tables.MissingColumns):
        tables.read_quoted(spark, write(tmp_path / "m.tsv", "entity_id\tname\nS1\tx\n"))
    lists = write(tmp_path / "l.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-2\n\nS1-2\t\nS1-3\n")
    got = {r.id: (r.line, r.list) for r in tables.read_lists(spark, lists).collect()}
    assert got == {"S1-1": (2, "S2-1,S2-2"), "S1-2": (4, ""), "S1-3": (5, None)}


def test_checks(spark):
    m = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", ""), ("S1-2", "S1-2,X-9"), ("S1-3", "S2-1,,S2-2"), ("S1-9", "S2-7")], "source1_entity_id string, matched_entity_ids string")
    c = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", None), ("S1-3", "S2-1,S2-2")], "source1_entity_id string, candidate_entity_ids string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",), ("S1-4",)], "entity_id string")
    targets = spark.createDataFrame([("S2-1",), ("S2-2",)], "entity_id string")
    found = {(r.file, r.check, r.subject) for r in V.all_findings(m, c, required, targets).collect()}
    own = {(k, s) for f, k, s in found if f == "matching_results"}
    assert own == {
        ("duplicate_row", "S1-1"), ("repeated_id", "S1-1"), ("self_match", "S1-2:S1-2"), ("foreign_id", "S1-2:X-9"), ("foreign_id", "S1-3:"), ("unknown_id", "S1-9:S2-7"), ("missing_source", "S1-4"), ("extra_source", "S1-9"),
        ("match_not_candidate", "S1-2"), ("match_not_candidate", "S1-3"), ("match_not_candidate", "S1-9"),
    }
    sums = {(r.file, r.check): (r.n, r.severity) for r in V.summary(V.all_findings(m, c, required, targets)).collect()}
    assert sums[("matching_results", "match_not_candidate")] == (3, "warning") and sums[("candidate_pairs", "missing_source")] == (1, "error")


def test_the_last_row_of_a_source_counts(spark):
    kinds = "line int, source1_entity_id string, {}_entity_ids string"
    m = spark.createDataFrame([(2, "S1-1", "S2-9"), (3, "S1-1", "S2-1"), (4, "S1-2", "S2-1")], kinds.format("matched"))
    c = spark.createDataFrame([(2, "S1-1", "S2-1"), (3, "S1-2", "S2-1"), (4, "S1-2", "")], kinds.format("candidate"))
    assert [r.subject for r in V.unmatched_candidates(m, c).collect()] == ["S1-2"]


def test_written_lists_are_read_back(spark, tmp_path):
    lists = spark.createDataFrame([(f"S1-{i:03d}", f"S2-{i}" if i % 3 else "") for i in range(50)], "source1_entity_id string, matched_entity_ids string")
    path = str(tmp_path / "m")
    tables.write_lists(lists.repartition(5), path, "matched_entity_ids")
    rows = lambda: sorted((r[1], r[2]) for r in tables.read_results(spark, path, "matched_entity_ids").collect())
    want = sorted((r[0], r[1]) for r in lists.collect())
    assert rows() == want
    tables.replace_lists(tables.read_results(spark, path, "matched_entity_ids").where("source1_entity_id < 'S1-010'"), path, "matched_entity_ids")
    assert rows() == want[:10]
    with pytest.raises(tables.MissingColumns):
        tables.read_results(spark, path, "candidate_entity_ids")


def test_rows_are_numbered_by_file(spark, tmp_path):
    for name, n in (("a", 3), ("b", 4000), ("c", 2)):
        write(tmp_path / f"{name}.txt", "".join(f"{name}{i}\n" for i in range(n)))
    got = [r.value for r in tables.numbered(spark.read.text(str(tmp_path)), "k").orderBy("k").collect()]
    assert got == [f"a{i}" for i in range(3)] + [f"b{i}" for i in range(4000)] + ["c0", "c1"]


def test_index_and_stream(spark, tmp_path, small):
    targets = spark.read.parquet(f"{small}/train_source2.parquet")
    file = write(tmp_path / "f.tsv", HEADER)
    index = str(tmp_path / "index")
    records, postings = manifest.open_index(spark, index, [file], targets)
    n = postings.count()
    assert records.count() == targets.count() and n > 0
    assert manifest.open_index(spark, index, [file], targets)[1].count() == n
    write(tmp_path / "f.tsv", HEADER + "more\n")
    with pytest.raises(manifest.StaleIndex):
        manifest.open_index(spark, index, [file], targets)
    sources = spark.read.parquet(f"{small}/train_source1.parquet").select("entity_id", "business_name", "business_address", "country", "src", "rid")
    sources.repartition(2).write.parquet(str(tmp_path / "in"))
    q = resolve_stream(spark, str(tmp_path / "in"), targets, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == sources.select("entity_id").distinct().count()


def test_command_line(spark, tmp_path, small):
    for i in (1, 2, 3):
        rows = spark.read.parquet(f"{small}/train_source{i}.parquet").na.fill("").collect()
        clean = lambda s: s.replace("\t", " ").replace("\n", " ").replace('"', "")
        write(tmp_path / f"test_source{i}.tsv", HEADER + "".join(f"{r.entity_id}\t{clean(r.business_name)}\t{clean(r.business_address)}\t{r.country}\n" for r in rows))
    out = tmp_path / "out"
    assert cli.main(["match", str(tmp_path), "--out", str(out)]) == 0
    args = ["validate", str(tmp_path), "--matches", f"{out}/matching_results", "--candidates", f"{out}/candidate_pairs", "--check-ids"]
    assert cli.main(args) == 0  # the folders as they are
    assert cli.main([*args[:2], "--matches", str(out / "none")]) == 1 and cli.main(["validate", str(out)]) == 1
    assert cli.main([*args[:5], str(out / "none"), "--check-ids"]) == 0  # missing candidates only warn
    assert cli.main(["match", str(tmp_path / "none")]) == 2


def test_malformed_files(spark, tmp_path):
    head = "Source1_Entity_Id \tmatched_entity_ids\n"
    for text, want, readable in [
        ("", [("empty_file", "")], False),
        ("source1_entity_id,matched_entity_ids\nS1-1,S2-1\n", [("comma_separated", "source1_entity_id,matched_entity_ids")], False),
        ("source1_entity_id\tids\nS1-1\tS2-1\n", [("wrong_header", "source1_entity_id\tids")], False),
        (head + "S1-1\tS2-1\n\nS1-2\n  \nS1-3\n", [("row_without_tab", "4:S1-2"), ("row_without_tab", "6:S1-3")], True),
        (head + "S1-1\tS2-1\n", [], True),
        (head + "S1-1\tS2-\udcff\n", [("not_utf8", "line 2")], False),
    ]:
        found, ok = V.malformed(tables.read_lines(spark, write(tmp_path / "r.tsv", text)), "matching_results", "matched_entity_ids")
        assert sorted((r.check, r.subject) for r in found.collect()) == want and ok == readable
    for i in (1, 2, 3):
        write(tmp_path / f"test_source{i}.tsv", HEADER + f"S{i}-1\tA\tB\tUS\n")
    for text, code in ((head + "S1-1\tS2-1\n", 0), (head + "S1-1\tS2-1\nS1-1\n", 1), ("id\tlist\nS1-1\tS2-1\n", 1)):
        assert cli.main(["validate", str(tmp_path), "--matches", write(tmp_path / "r.tsv", text)]) == code
