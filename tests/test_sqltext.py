import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names, sqltext


def value(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("sql", "tables", "operation"),
    [
        ("SELECT id, name FROM users WHERE status = 1", ["users"], "SELECT"),
        ("INSERT INTO orders (id, amount) VALUES (1, 99.9)", ["orders"], "INSERT"),
        ("SELECT * FROM users u JOIN orders o ON u.id = o.uid", ["users", "orders"], "SELECT"),
        ("  delete from sessions where t < 1", ["sessions"], "DELETE"),
        ("REPLACE INTO `cache` VALUES (1)", ["cache"], "INSERT"),
        ("SELECT 1 FROM DUAL", [], "SELECT"),
        ("INSERT INTO a (x) VALUES (1) ON DUPLICATE KEY UPDATE y = 2", ["a", "y"], "INSERT"),
        ("", [], "SELECT"),
    ],
)
def test_generic(spark, sql, tables, operation):
    assert value(spark, sql, sqltext.table_names) == tables
    assert value(spark, sql, sqltext.operation) == operation


def test_dialects(spark):
    cte = "WITH active AS (SELECT id FROM users) SELECT * FROM active JOIN orders ON 1 = 1"
    assert value(spark, cte, sqltext.pg_tables) == ["users", "orders"]
    assert value(spark, 'UPDATE "users" SET a = 1', sqltext.pg_tables) == ["users"]
    assert value(spark, "INSERT INTO users (a) VALUES (1) RETURNING id, name AS n", sqltext.returning_columns) == ["id", "name"]
    assert value(spark, "SELECT 1 FROM `users` JOIN `orders`", sqltext.mysql_tables) == ["users", "orders"]
    assert value(spark, "SELECT 1 FROM `s`.`t`, `u`.`t`", sqltext.mysql_schemas) == {"t": "u"}
    assert value(spark, "jdbc:pgsql://x", sqltext.db_type) == "POSTGRESQL"
    assert value(spark, "Microsoft SQL", sqltext.db_type_of_product) == "SQLSERVER"


def test_columns(spark):
    refs = lambda sql: [(r["table"], r["column"]) for r in value(spark, sql, sqltext.column_refs)]
    assert refs("SELECT u.id, o.id FROM u JOIN o ON u.id = o.uid") == [("u", "id"), ("o", "id"), ("o", "uid")]
    assert refs("INSERT INTO t (`a`, b) VALUES (1, 2)") == [(None, "a"), (None, "b")]
    assert refs("UPDATE t SET a = 1, b = 2 WHERE c = 3") == [(None, "a"), (None, "b")]


@pytest.mark.parametrize(
    ("text", "path"),
    [
        ('x.post("http://user-service/api/login", r)', "/api/login"),
        ("x.get(http://order-service/api/orders/123)", "/api/orders/123"),
        ("x.get(https://a/b,c)", "/b"),
        ("x.get(http://nopath)", None),
        ("helper.m()", None),
    ],
)
def test_url_path(spark, text, path):
    assert value(spark, text, names.url_path) == path


def test_names(spark):
    assert value(spark, "dubboService.someMethod(param1)", names.rpc_method) == "someMethod"
    assert value(spark, "service.someMethod(param1)", names.rpc_method) is None
    assert value(spark, "app:pkg.C.f(java.util.List)", names.method_name) == "f"
    assert value(spark, "app:pkg.C.f(java.util.List)", names.signature_of) == "List)"
    assert value(spark, "pkg.C.f", names.app_of) == "unknown"
    assert value(spark, "deleteAll", sqltext.operation_of_name) == "DELETE"


def test_class_of_ids(spark):
    from sparkloom.functions import names

    ids = {"app:a.b.C.run(x.Y)": "C", "C.run()": "C", "run()": "run", "app:C.run": "C", "": "", None: ""}
    got = {r["i"]: r["c"] for r in spark.createDataFrame([(i,) for i in ids], "i string").select("i", names.class_of(F.col("i")).alias("c")).collect()}
    assert got == ids
