"""Methods, calls, class hierarchy and metrics of Java source files.

A scan maps a small token reader over the files, so Spark splits the files and no text is shuffled; it leaves a row a
file with all its types and methods. Everything else is built-in functions and joins over those rows. Comments and
string literals hold no declarations and no calls; constructors are no methods; types within types have methods of
their own, and methods of anonymous classes belong to the type around them.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.scratch import saved
from sparkloom.sources.javascan import Scanner

# What makes a scope external, which class annotations bring getters and setters along, which annotations
# mark entries of which framework (on a class, on a method), and which carry a path and verb, first to last.
EXTERNAL_SCOPES = r"restTemplate|webClient|kafkaTemplate|rabbitTemplate|dubbo|feign|jdbcTemplate|redisTemplate|mongoTemplate"
GENERATED = r"^(?:[\w.]+\.)?(?:Getter|Setter|Data|Value|Builder|ToString|EqualsAndHashCode|RequiredArgsConstructor|NoArgsConstructor|AllArgsConstructor|With|Accessors|Slf4j|Log|Log4j2|Generated)$"
DETECTORS = [
    ("Spring", "HTTP", "RequestMapping|GetMapping|PostMapping|PutMapping|DeleteMapping|PatchMapping", False, True),
    ("Dubbo", "RPC", "DubboService|ShenyuDubboService", True, False),
    ("ShenYu", "HTTP", "RestApi", False, True),
    ("gRPC", "RPC", "GrpcService", True, True),
    ("Kafka", "MQ", "KafkaListener", False, True),
]
PATHS = ["PostMapping", "GetMapping", "RequestMapping", "PutMapping", "DeleteMapping"]
VERBS = {"PostMapping": "POST", "GetMapping": "GET", "PutMapping": "PUT", "DeleteMapping": "DELETE", "PatchMapping": "PATCH"}

_NAMED = [("name", pa.string()), ("value", pa.string())]
_PARAM = [("type", pa.string()), ("name", pa.string())]
_CALL = [("kind", pa.string()), ("scope", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("expression", pa.string())]
_WORDS = pa.list_(pa.string())
_TYPE = [("name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("annotations", _WORDS), ("extends", _WORDS), ("implements", _WORDS)]
_METHOD = [
    ("class_name", pa.string()), ("class_annotations", _WORDS), ("name", pa.string()), ("return_type", pa.string()), ("params", pa.list_(pa.struct(_PARAM))),
    ("annotations", pa.list_(pa.struct(_NAMED))), ("line", pa.int32()), ("has_body", pa.bool_()), ("body", pa.string()), ("calls", pa.list_(pa.struct(_CALL))),
]
_FILE = [("error", pa.string()), ("package", pa.string()), ("branches", pa.int64()), ("types", pa.list_(pa.struct(_TYPE))), ("methods", pa.list_(pa.struct(_METHOD)))]


def _ddl(kind: pa.DataType) -> str:
    if pa.types.is_list(kind):
        return f"array<{_ddl(kind.value_type)}>"
    if pa.types.is_struct(kind):
        return "struct<" + ", ".join(f"{f.name}: {_ddl(f.type)}" for f in kind) + ">"
    return {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}[kind]


SCAN = "path string, " + ", ".join(f"{name} {_ddl(kind)}" for name, kind in _FILE)


def _read(text: str | None, calls: bool = True) -> tuple:
    """The values of _FILE; a file that can't be read says why, and has nothing in it."""
    try:
        found, error = Scanner(text or "", calls), None
    except RecursionError:
        found, error = Scanner(""), "nests too deeply"
    return error, found.package, found.branches(), found.types, found.methods


def scan(files: DataFrame, calls: bool = True) -> DataFrame:
    """SCAN, and what other columns `files` has: a row for each file of path, content; a null content is empty. error says why a file could not be read, and is null for others.

    Without `calls` those of methods are empty, which takes less time.
    """
    kept = [c for c in files.columns if c not in ("path", "content")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gc.disable()  # rows hold no cycles; the collector would go over all of a batch again and again
            try:
                rows = [_read(text, calls) for text in batch.column(1).to_pylist()]
                columns = zip(*rows, strict=True) if rows else [[] for _ in _FILE]
                found = [pa.array(list(c), t) for c, (_, t) in zip(columns, _FILE, strict=True)]
            finally:
                gc.enable()
            yield pa.RecordBatch.from_arrays([batch.column(0), *found, *batch.columns[2:]], names=["path", *(n for n, _ in _FILE), *kept])

    rows = files.select(F.col("path").cast("string"), F.col("content").cast("string"), *(F.col(f"`{c}`") for c in kept))
    return rows.mapInArrow(run, StructType([*StructType.fromDDL(SCAN).fields, *(rows.schema[c] for c in kept)]))


def _types(scanned: DataFrame) -> DataFrame:
    rows = scanned.select("path", "package", F.explode("types").alias("t"))
    return rows.select("path", "package", F.col("t.name").alias("class_name"), "t.kind", "t.line", "t.annotations", F.get("t.extends", F.lit(0)).alias("parent"), F.col("t.implements").alias("interfaces"))


def types(files: DataFrame) -> DataFrame:
    """path, package, class_name, kind, line, annotations, parent (first extended), interfaces (array): every type of each file."""
    return _types(scan(files, calls=False))


def _entries(class_marks: Column, marks: Column, path: Column, verb: Column, class_name: Column, name: Column) -> Column:
    """All detections of a method: a class-level mark names the class as path and the method as verb."""
    found = []
    for framework, kind, wanted, on_class, on_method in DETECTORS:

        def seen(at: Column, p: Column, v: Column, whole: bool, f: str = framework, k: str = kind, w: str = wanted) -> Column:
            one = F.struct(F.lit(f).alias("framework"), F.lit(k).alias("type"), p.alias("path"), v.alias("verb"), F.lit(whole).alias("class_level"))
            return F.transform(F.filter(at, lambda mark: mark.rlike(rf"^(?:{w})$")), lambda _: one)

        found += [seen(class_marks, class_name, name, True)] * on_class + [seen(marks, path, verb, False)] * on_method
    return F.concat(*found)


def _accessor(name: Column, n_params: Column, class_marks: Column, body: Column) -> Column:
    """A plain getter or setter: named so, and in a class with generated ones or with one line about its field."""
    made = F.exists(class_marks, lambda a: a.rlike(GENERATED))
    sets = (n_params == 1) & name.rlike("^set[A-Z]")
    gets = (n_params == 0) & (F.length(name) > 3) & name.rlike("^(?:get|is)[A-Z]")
    return sets & (made | body.rlike(r"^this\.\w+ = \w+;$")) | gets & (made | body.rlike(r"^return this\.\w+;$"))


def methods_of(scanned: DataFrame) -> DataFrame:
    """methods() and the calls of each, of files that are scanned already."""
    rows = scanned.select("path", "package", F.explode("methods").alias("m")).select("path", "package", "m.*")
    rows = rows.where(~_accessor(F.col("name"), F.size("params"), F.col("class_annotations"), F.col("body")))
    marks = F.transform("annotations", lambda a: a["name"])
    said = lambda wanted: F.get(F.filter("annotations", lambda a: a["name"] == wanted), F.lit(0))
    path = F.coalesce(*(F.when(said(n).isNotNull(), F.struct(said(n)["value"].alias("v"))) for n in PATHS))["v"]
    verb = F.coalesce(*(F.when(F.array_contains(marks, n), v) for n, v in VERBS.items()))
    kinds = F.transform("params", lambda p: p["type"])
    rows = rows.withColumns({"http_path": path, "http_method": verb, "param_types": kinds})
    return rows.select(
        "path", "package", "class_name", "name", F.concat("name", F.lit("("), F.array_join("param_types", ", "), F.lit(")")).alias("signature"), "return_type", "param_types", "params",
        F.concat("class_annotations", marks).alias("annotations"), "line", (~F.col("has_body")).alias("is_abstract"), "http_path", "http_method", "calls",
        _entries(F.col("class_annotations"), marks, F.col("http_path"), F.col("http_method"), F.col("class_name"), F.col("name")).alias("entries"),
    ).withColumn("is_entry", F.size("entries") > 0).withColumn("id", F.concat(F.when(F.col("package") == "", "").otherwise(F.concat("package", F.lit("."))), "class_name", F.lit("."), "name", F.lit("("), F.array_join("param_types", ","), F.lit(")")))


def methods(files: DataFrame) -> DataFrame:
    """path, package, class_name, name, signature, return_type, param_types, params, annotations (the class's, then its own), line, is_abstract, http_path, http_method, entries, is_entry, id.

    Plain getters and setters are left out. id is package.class.name(types), to which an app is put in front.
    """
    return methods_of(scan(files, calls=False)).drop("calls")


def entry_points(files: DataFrame) -> DataFrame:
    """class_name, signature, framework, type, path, verb, class_level: every detection of every method."""
    return methods_of(scan(files, calls=False)).select("class_name", "signature", F.explode("entries").alias("e")).select("class_name", "signature", "e.*")


def first_of_each(found: DataFrame) -> DataFrame:
    """Of the methods of one id (of methods()) the first by path, then by line."""
    return found.groupBy("id").agg(F.min_by(F.struct(*found.columns), F.struct("path", "line")).alias("m")).select("m.*")


def calls_of(scanned: DataFrame) -> DataFrame:
    """calls() of files that are scanned already."""
    rows = methods_of(scanned).select("path", "class_name", F.col("name").alias("caller"), "signature", F.explode("calls").alias("c"))
    outside = (F.col("kind") != "new") & F.col("scope").rlike(EXTERNAL_SCOPES)
    return rows.select("path", "class_name", "caller", "signature", "c.scope", "c.name", "c.kind", "c.line", "c.expression").withColumn("call_type", F.when(outside, "EXTERNAL").otherwise("INTERNAL"))


def calls(files: DataFrame) -> DataFrame:
    """path, class_name, caller, signature, scope, name, kind, line, expression, call_type: `call` (scope.name or this.name), `reference` (scope::name), `new`."""
    return calls_of(scan(files))


def _links(scanned: DataFrame) -> DataFrame:
    """child_package, child, parent (simple name), relation: implements (of classes) or extends (the first)."""
    found = _types(scanned).where("kind IN ('class', 'interface')").select(F.col("package").alias("child_package"), F.col("class_name").alias("child"), "kind", F.col("parent").alias("extended"), "interfaces")
    link = lambda parent, relation: F.struct(parent.alias("parent"), F.lit(relation).alias("relation"))
    implemented = F.when(F.col("kind") == "class", F.transform("interfaces", lambda i: link(i, "implements"))).otherwise(F.array())
    extended = F.when(F.col("extended").isNotNull(), F.array(link(F.col("extended"), "extends"))).otherwise(F.array())
    # one pass: a union of both would read every file twice
    return found.select("child_package", "child", F.explode(F.concat(implemented, extended)).alias("l")).select("child_package", "child", "l.*")


def hierarchy(files: DataFrame) -> DataFrame:
    """child, parent (simple names), relation: implements or extends."""
    return _links(scan(files, calls=False)).select("child", "parent", "relation")


def package_override_edges(files: DataFrame) -> DataFrame:
    """parent_package, parent_class, child_package, child_class, signature: abstract methods and those of like signature in types below them.

    A parent is the type of that name in the child's package; where the package has none, the types of that name
    anywhere, of which each signature is taken from the smallest package.
    """
    plain = lambda m: _accessor(m["name"], F.size(m["params"]), m["class_annotations"], m["body"])
    kinds = lambda m: F.array_join(F.transform(m["params"], lambda p: p["type"]), ", ")
    said = lambda m: F.struct(m["class_name"].alias("class_name"), F.concat(m["name"], F.lit("("), kinds(m), F.lit(")")).alias("signature"), (~m["has_body"]).alias("is_abstract"))
    # what edges are made of is kept, not all of a scan
    scanned = saved(scan(files, calls=False).select("path", "package", "types", F.transform(F.filter("methods", lambda m: ~plain(m)), said).alias("methods")))
    found = scanned.select("package", F.explode("methods").alias("m")).select("package", "m.*").distinct()
    links = _links(scanned).select("child_package", "child", "parent").distinct()
    known = _types(scanned).select(F.col("package").alias("child_package"), F.col("class_name").alias("parent"), F.lit(True).alias("near")).distinct()
    above = found.where("is_abstract").select(F.col("package").alias("parent_package"), F.col("class_name").alias("parent"), "signature")
    first = above.groupBy("parent", "signature").agg(F.min("parent_package").alias("parent_package"))
    below = found.select(F.col("package").alias("child_package"), F.col("class_name").alias("child"), "signature")
    asked = links.join(known, ["child_package", "parent"], "left").join(below, ["child_package", "child"])
    near = asked.where("near").withColumn("parent_package", F.col("child_package")).join(above, ["parent_package", "parent", "signature"])
    far = asked.where("near IS NULL").join(first, ["parent", "signature"])
    edges = near.unionByName(far, allowMissingColumns=True)
    return edges.select("parent_package", F.col("parent").alias("parent_class"), "child_package", F.col("child").alias("child_class"), "signature").distinct()


def override_edges(files: DataFrame) -> DataFrame:
    """parent_class, child_class, signature of `package_override_edges`, a row for each edge."""
    return package_override_edges(files).select("parent_class", "child_class", "signature")


def metrics(files: DataFrame, *more: str) -> DataFrame:
    """path, lines, comment_lines, n_classes (interfaces too), n_methods (accessors too), complexity: if, for, while, catch, switch entries and conditional expressions; and the columns of `files` that `more` names."""
    rows = F.split("content", "\n")
    comment = F.size(F.filter(rows, lambda x: F.trim(x).rlike(r"^(//|/\*|\*)")))
    scanned = scan(files.select("path", "content", F.size(rows).cast("long").alias("lines"), comment.cast("long").alias("comment_lines"), *more), calls=False)
    kinds = F.filter("types", lambda t: t["kind"].isin("class", "interface"))
    return scanned.select("path", "lines", "comment_lines", F.size(kinds).cast("long").alias("n_classes"), F.size("methods").cast("long").alias("n_methods"), F.col("branches").alias("complexity"), *more)
