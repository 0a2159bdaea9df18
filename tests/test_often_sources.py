import pytest

from sparkloom.operators import resolve

METHODS = "method_id long, app_id int, signature string, full_id string"


@pytest.mark.parametrize("often", [3, 1000])
def test_sources_of_many_calls_resolve_as_others(spark, monkeypatch, often):
    """All calls of one source were one task's."""
    monkeypatch.setattr(resolve, "OFTEN", often)
    methods = spark.createDataFrame([(1, 0, "run()", "a.run()"), (2, 0, "runs()", "a.runs()"), (3, 1, "z()", "a.z()"), (4, 1, "zz()", "a.z()")], METHODS)
    said = ["a.run()"] * 5 + ["b.run(x)"] * 6 + ["b.none()"] * 7 + ["a.z()", "b.runs()", None]
    raw = spark.createDataFrame([(f"c{i}", s) for i, s in enumerate(said)], "call_id string, source string")
    got = sorted(map(tuple, resolve.resolve_callers(raw, methods).collect()))
    want = [(f"c{i}", 1, "exact") for i in range(5)] + [(f"c{i}", 1, "prefix") for i in range(5, 11)] + [("c18", 3, "exact"), ("c18", 4, "exact"), ("c19", 2, "prefix")]
    assert got == sorted(want)


def test_ranges_of_prefixes_hold_a_bounded_number_of_texts(spark, monkeypatch):
    monkeypatch.setattr(resolve, "RANGE_TEXTS", 50)
    seen = []
    real = resolve.F.lit
    monkeypatch.setattr(resolve.F, "lit", lambda x: (seen.append(len(x)) if isinstance(x, list) else None) or real(x))
    texts = spark.range(2000).selectExpr("concat('m', id, '()') AS whole")
    found = resolve.beginnings(spark.createDataFrame([("m1",), ("m19",), ("x",)], "name string"), texts)
    assert found.groupBy("name").count().orderBy("name").collect() == [("m1", 1111), ("m19", 111)] and seen == [39]
