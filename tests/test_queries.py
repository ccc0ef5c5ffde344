import pytest

from compare import differences, spark_rows, sql_rows
from kinlink import queries as core


@pytest.mark.parametrize("name", sorted(core.ORACLE_SQL))
def test_against_sql(spark, small, name):
    assert differences(spark_rows(core.QUERIES[name](spark, small)), sql_rows(small, core.ORACLE_SQL[name])) == ""


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["source_id", "target_id"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_classifier(spark, small):
    r = core.QUERIES["classifier_report"](spark, small).first()
    assert 0.1 <= r.threshold <= 0.94 and 0 <= r.macro_f05 <= 1 and r.pairs > r.positive_pairs > 0


def test_classifier_queries_fit_all_rounds(spark, small, monkeypatch):
    import inspect

    from kinlink.plans import model
    from kinlink.queries import QUERIES

    seen = []
    for name, result in (("trained", (None, None)), ("report", None)):
        kind = inspect.signature(getattr(model, name))

        def fake(*a, _kind=kind, _result=result, **k):
            bound = _kind.bind(*a, **k)
            bound.apply_defaults()
            seen.append(bound.arguments["rounds"])
            return _result

        monkeypatch.setattr(model, name, fake)
    for name in ("classifier_scores", "classifier_report"):
        QUERIES[name](spark, small)
    assert seen == [350, 350]
