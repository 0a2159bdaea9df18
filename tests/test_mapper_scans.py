from sparkloom.sources import java, mappers

TEXT = 'package p;\nclass C {\n  private final SMapper sMapper;\n  void m() { sMapper.insert(x); }\n  void n() { other.insert(x); }\n  void o() { f(); }\n}'


def test_calls_are_scanned_once(spark):
    """Names of mappers' methods and the calls of these were found by a scan of all files each."""
    files = spark.createDataFrame([("C.java", TEXT)], "path string, content string")
    used = spark.createDataFrame([("p", "C", "sMapper", "SMapper", "s")], "package string, class_name string, variable string, mapper string, table_name string")
    found = mappers.operation_of_calls(java.calls(files), used)
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [("C.java", "m", "INSERT"), ("C.java", "n", "INSERT")]
