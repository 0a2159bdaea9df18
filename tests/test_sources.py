from sparkloom.sources import java, listings, mappers

CONTROLLER = '''package com.demo;
/* class Fake { } */
@RestController
public class UserController extends Base implements Api, Serializable {
    private final UserService service;
    // restTemplate.get("http://no")
    @PostMapping("/api/users/login")
    public String login(String name, int age) {
        if (age > 3) { service.check(name); }
        restTemplate.postForObject("http://app-b/api/orders", name); // note(x)
        names.forEach(Printer::print);
        return helper();
    }

    protected void run() throws Exception { new Thread(1).start(); }
}
'''
API = "package com.demo;\npublic interface Api {\n    String login(String name, int age);\n}\n"


def files(spark):
    return spark.createDataFrame([("A.java", CONTROLLER), ("B.java", API), ("C.java", ""), ("D.java", None)], "path string, content string")


def test_methods(spark):
    got = {(r["class_name"], r["signature"]): r for r in java.methods(files(spark)).collect()}
    assert set(got) == {("UserController", "login(String, int)"), ("UserController", "run()"), ("Api", "login(String, int)")}
    login = got["UserController", "login(String, int)"]
    assert (login["is_entry"], login["http_path"], login["http_method"], login["is_abstract"]) == (True, "/api/users/login", "POST", False)
    assert got["Api", "login(String, int)"]["is_abstract"]


def test_accessors_are_left_out(spark):
    body = "{\n private int a;\n public int getA() { return this.a; }\n public void setA(int a) { this.a = a; }\n public int getB() { return compute(); }\n public boolean isOn() { return on; }\n}"
    frame = spark.createDataFrame([("P.java", "class P " + body), ("L.java", "@lombok.Data\nclass L " + body)], "path string, content string")
    assert {(r["class_name"], r["name"]) for r in java.methods(frame).collect()} == {("P", "getB"), ("P", "isOn")}


def test_entry_points(spark):
    text = '@DubboService(version = "1")\nclass D implements A {\n @KafkaListener(topics = "t")\n public void on(String m) { }\n @GetMapping("/x")\n public String x() { return "@PostMapping"; }\n}'
    frame = spark.createDataFrame([("D.java", text)], "path string, content string")
    got = {tuple(r)[1:] for r in java.entry_points(frame).collect()}
    assert got == {
        ("on(String)", "Dubbo", "RPC", "D", "on", True), ("on(String)", "Kafka", "MQ", None, None, False),
        ("x()", "Dubbo", "RPC", "D", "x", True), ("x()", "Spring", "HTTP", "/x", "GET", False),
    }


def test_calls(spark):
    got = {(r["caller"], r["scope"], r["name"], r["call_type"], r["kind"]) for r in java.calls(files(spark)).collect()}
    assert ("login", "service", "check", "INTERNAL", "call") in got
    assert ("login", "restTemplate", "postForObject", "EXTERNAL", "call") in got
    assert ("login", "this", "helper", "INTERNAL", "call") in got
    assert ("login", "Printer", "print", "INTERNAL", "reference") in got
    assert ("run", "Thread", "<init>", "INTERNAL", "new") in got
    assert not [x for x in got if x[2] == "note"]


def test_hierarchy_and_overrides(spark):
    down = {(r["child"], r["parent"], r["relation"]) for r in java.hierarchy(files(spark)).collect()}
    assert down == {("UserController", "Api", "implements"), ("UserController", "Serializable", "implements"), ("UserController", "Base", "extends")}
    assert [tuple(r) for r in java.override_edges(files(spark)).collect()] == [("Api", "UserController", "login(String, int)")]


def test_overrides_keep_to_the_package(spark):
    texts = [f"package pkg{i};\ninterface Foo {{\n String bar();\n}}" for i in (1, 2)] + [f"package pkg{i};\nclass FooImpl implements Foo {{\n public String bar() {{ return x; }}\n}}" for i in (1, 2, 3)]
    texts += ["package pkg1;\nabstract class Step {\n abstract void run();\n}", "package pkg2;\nclass Step {\n void run() { go(); }\n}", "package pkg2;\nclass Last extends Step {\n void run() { go(); }\n}"]
    frame = spark.createDataFrame([(f"{i}.java", t) for i, t in enumerate(texts)], "path string, content string")
    assert [tuple(r) for r in java.override_edges(frame).collect()] == [("Foo", "FooImpl", "bar()")] * 3
    got = sorted(tuple(r) for r in java.package_override_edges(frame).collect())
    # pkg3 has no Foo of its own; pkg2's Step is not abstract
    assert got == [("pkg1", "Foo", "pkg1", "FooImpl", "bar()"), ("pkg1", "Foo", "pkg3", "FooImpl", "bar()"), ("pkg2", "Foo", "pkg2", "FooImpl", "bar()")]


def test_mappers(spark):
    texts = [
        ("M.java", "interface UserMapper extends BaseMapper<UserPO> {}"),
        ("P.java", '@TableName("users")\nclass UserPO {\n private Long id;\n private String name;\n private int age;\n}'),
        ("S.java", "class UserService {\n private UserMapper userMapper;\n}"),
        ("O.java", "interface OldMapper extends BaseMapper<OldPO> {}"),
        ("Q.java", '@TableName(value = "old")\nclass OldPO {}'),
    ]
    frame = spark.createDataFrame(texts, "path string, content string")
    found = mappers.discovered(frame)
    assert {(r["mapper"], r["table_name"], r["columns"]) for r in found.collect()} == {("UserMapper", "users", "age,name"), ("OldMapper", "old", "")}
    used = mappers.usage(frame, found)
    assert [(r["class_name"], r["variable"]) for r in used.collect()] == [("UserService", "userMapper")]
    assert [r["mapper"] for r in mappers.stubs(found, used).collect()] == ["OldMapper"]


def test_xml(spark):
    xml = '<mapper namespace="a.UserMapper"><select id="get" resultType="x">SELECT * FROM users <where>id = 1</where></select><resultMap id="r">FROM maps</resultMap></mapper>'
    got = {(r["source"], r["operation"], r["table_name"]) for r in mappers.xml_statements(spark.createDataFrame([("mapper/m.xml", xml), ("other/m.xml", xml)], "path string, content string")).collect()}
    assert got == {("a.UserMapper.get", "SELECT", "users"), ("a.UserMapper.r", "SELECT", "maps")}


def test_xml_nested_tags_includes_and_broken_files(spark):
    """Text of nested tags stays in its place, fragments (of fragments, of other files, unknown ones) are filled in, a bad file costs itself alone."""
    doctype = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE mapper PUBLIC "-//mybatis.org//DTD Mapper 3.0//EN" "http://mybatis.org/dtd/mybatis-3-mapper.dtd">\n'
    one = doctype + """<mapper namespace="a.M"><sql id="base">FROM users u <include refid="more"/></sql><sql id="more">JOIN roles r ON r.id &lt; u.id</sql>
      <select id="get">SELECT u.id, <if test="x != null and y > 1">u.name</if> <include refid="base"/> <where><if test="a">u.id > 1</if><foreach collection="l" item="i" open="(" close=")">, #{i}</foreach></where></select>
      <insert id="add"><selectKey keyProperty="id">SELECT max(id) FROM keys</selectKey>INSERT INTO users (id) VALUES (1)</insert>
      <update id="set"><![CDATA[UPDATE users SET a = 1 WHERE b < 2 AND c > 3]]></update><delete id="all">DELETE FROM <!-- FROM hidden --> users</delete><select id="ns">SELECT 1 <include refid="b.N.far"/><include refid="none"/></select></mapper>"""
    two = '<mapper namespace="b.N"><sql id="far">FROM elsewhere</sql><select id="empty"/></mapper>'
    files = [("x/mapper/1.xml", one), ("x/mapper/2.xml", two), ("x/mapper/3.xml", one[:-9]), ("x/mapper/4.xml", "no xml"), ("x/mapper/5.xml", None), ("x/mapper/6.xml", "<other><select id='q'>SELECT 1 FROM t</select></other>")]
    frame = spark.createDataFrame(files, "path string, content string")
    errors = {r["path"][-5]: r["error"] for r in mappers.xml_files(frame).collect()}
    assert errors["1"] is errors["2"] is errors["6"] is None and errors["3"] == errors["4"] == errors["5"] == "no well-formed XML"
    got = {}
    for r in mappers.xml_statements(frame).collect():
        got.setdefault((r["source"], r["operation"]), (set(), r["sql"]))[0].add(r["table_name"])
    assert {k: v[0] for k, v in got.items()} == {
        ("a.M.base", "SELECT"): {"users", "roles"}, ("a.M.more", "SELECT"): {"roles"}, ("a.M.get", "SELECT"): {"users", "roles"}, ("a.M.add", "INSERT"): {"keys", "users"},
        ("a.M.set", "UPDATE"): {"users"}, ("a.M.all", "DELETE"): {"users"}, ("a.M.ns", "SELECT"): {"elsewhere"}, ("b.N.far", "SELECT"): {"elsewhere"}, (".q", "SELECT"): {"t"},
    }
    assert got["a.M.get", "SELECT"][1] == "SELECT u.id, u.name FROM users u JOIN roles r ON r.id < u.id u.id > 1 , #{i}"
    assert got["a.M.set", "UPDATE"][1] == "UPDATE users SET a = 1 WHERE b < 2 AND c > 3"


def test_test_folders_are_not_scanned(spark):
    frame = spark.createDataFrame([("src/main/A.java", API), ("src/test/B.java", API), ("src/main/a.xml", "")], "path string, content string")
    assert [r["path"] for r in listings.java_files(frame).collect()] == ["src/main/A.java"]
    assert [r["path"] for r in listings.java_files(frame, ["src/test/B.java", "src/main/a.xml", "none.java"]).collect()] == ["src/test/B.java"]


HARD = """package com.x;
@RestController
public class C<T extends Foo> extends Base<T> implements A<Map<String, Integer>>, b.c.D {
  private final Svc svc = new Svc() { public int run(int q) { return go(q); } };
  enum Color { RED("r") { String x() { return "}"; } }, BLUE; String label() { return name(); } }
  public record P(int a, String b) { P { check(a); } int sum() { return a + b.length(); } }
  public C(Svc svc) { this.svc = svc; svc.init(); }
  @GetMapping("/x/{id}")
  public Map<String, List<Integer>> get(@PathVariable("id") Long id, @Valid(value = {1, 2}) final Map<String, Integer> q, int... more) throws IOException {
     // foo(x)
     String s = "a { b( }"; char c = '}';
     if (id > 3 ? true : false) { a.b().c(q.get("x")); }
     do { x(); } while (y);
     list.forEach(Printer::print); Collections.<String>emptyList().size();
     switch (z) { case 1: break; default: foo(); }
     return super.get(id);
  }
  abstract <R> R gen(List<? extends R> in);
  static class Inner { void in1() { helper(); } }
}
interface Second extends Up<String>, Other { int two(String s); }
"""


def test_ordinary_java(spark):
    """Annotated and generic parameters, constructors, nested and second types, records, enums, anonymous classes, chained calls."""
    frame = spark.createDataFrame([("C.java", HARD), ("bad.java", "class { ( [ } ) @"), ("deep.java", "class D { void m() { " + "{" * 3000), ("e.java", "")], "path string, content string")
    found = {(r["class_name"], r["signature"]): r for r in java.methods(frame).collect()}
    assert set(found) == {
        ("C", "run(int)"), ("Color", "x()"), ("Color", "label()"), ("P", "sum()"), ("C", "get(Long, Map<String, Integer>, int...)"), ("C", "gen(List<? extends R>)"), ("Inner", "in1()"), ("Second", "two(String)"), ("D", "m()"),
    }
    get = found["C", "get(Long, Map<String, Integer>, int...)"]
    assert (get["http_path"], get["http_method"], get["return_type"], get["line"], get["is_abstract"]) == ("/x/{id}", "GET", "Map<String, List<Integer>>", 9, False)
    assert [p["name"] for p in get["params"]] == ["id", "q", "more"] and get["annotations"] == ["RestController", "GetMapping"]
    assert get["id"] == "com.x.C.get(Long,Map<String, Integer>,int...)"
    assert found["C", "gen(List<? extends R>)"]["is_abstract"] and not found["C", "run(int)"]["is_entry"]
    said = {(r["scope"], r["name"]) for r in java.calls(frame).where("caller = 'get'").collect()}
    assert said == {("a", "b"), ("a.b()", "c"), ("q", "get"), ("this", "x"), ("list", "forEach"), ("Printer", "print"), ("Collections", "emptyList"), ("Collections.<String> emptyList()", "size"), ("this", "foo"), ("super", "get")}
    down = {(r["child"], r["parent"], r["relation"]) for r in java.hierarchy(frame).collect()}
    assert down == {("C", "Base", "extends"), ("C", "A", "implements"), ("C", "D", "implements"), ("Second", "Up", "extends")}
    row = next(r for r in java.metrics(frame).collect() if r["path"] == "C.java")
    assert (row["complexity"], row["n_classes"], row["n_methods"]) == (4, 3, 8)


def test_layered_project(spark):
    """A controller, a service and a mapper with its implementation: two entries and at least four internal calls."""
    texts = [
        'package e.c;\n@RestController\npublic class UserController {\n private final UserService userService = new UserService();\n @GetMapping("/api/users/{id}")\n public UserDTO getUser(@PathVariable Long id) {\n  return userService.getUser(id);\n }\n @PostMapping("/api/users")\n public UserDTO createUser(@RequestBody Request req) {\n  return userService.createUser(req);\n }\n}',
        "package e.s;\npublic class UserService {\n private final UserMapper userMapper = new UserMapperImpl();\n public UserDTO getUser(Long id) {\n  return userMapper.selectById(id);\n }\n public UserDTO createUser(Request req) {\n  userMapper.insert(req.getName(), req.getEmail());\n  return userMapper.selectByEmail(req.getEmail());\n }\n}",
        "package e.m;\npublic interface UserMapper {\n UserDTO selectById(Long id);\n UserDTO selectByEmail(String email);\n int insert(String name, String email);\n}",
        "package e.m;\npublic class UserMapperImpl implements UserMapper {\n public UserDTO selectById(Long id) {\n  // SELECT * FROM users WHERE id = #{id}\n  return new UserDTO();\n }\n public UserDTO selectByEmail(String email) { return new UserDTO(); }\n public int insert(String name, String email) { return 1; }\n}",
    ]
    frame = spark.createDataFrame([(f"{i}.java", t) for i, t in enumerate(texts)], "path string, content string")
    assert {(r["http_method"], r["http_path"], r["signature"]) for r in java.methods(frame).where("is_entry").collect()} == {("GET", "/api/users/{id}", "getUser(Long)"), ("POST", "/api/users", "createUser(Request)")}
    assert java.calls(frame).where("call_type = 'INTERNAL'").count() >= 4
    assert {r["signature"] for r in java.override_edges(frame).collect()} == {"selectById(Long)", "selectByEmail(String)", "insert(String, String)"}


def test_mappers_taken_by_constructors_and_by_class_names(spark):
    texts = [
        ("M.java", "package a;\ninterface OMapper extends BaseMapper<OPO> {}"),
        ("P.java", '@TableName("orders")\nclass OPO {\n private String name;\n}'),
        ("S.java", "package a.b;\nclass S {\n public S(OMapper om) {}\n void run() {}\n}"),
        ("T.java", "package z;\nclass S {\n private OMapper o;\n}"),
    ]
    frame = spark.createDataFrame(texts, "path string, content string")
    found = mappers.discovered(frame)
    used = mappers.usage(frame, found)
    assert {(r["package"], r["class_name"], r["variable"]) for r in used.collect()} == {("a.b", "S", None), ("z", "S", "o")}
    assert mappers.stubs(found, used).count() == 0
    methods = spark.createDataFrame([(1, "a.b.S"), (2, "b.S"), (3, "S"), (4, "X")], "method_id long, class_name string")
    assert {r["method_id"] for r in mappers.mappers_of(methods, used).collect()} == {1, 2, 3}
    none = spark.createDataFrame([], "method_id long, operation string")
    rows = mappers.relations(methods.where("method_id = 4"), none, used, found)
    assert [(r["source"], r["columns"]) for r in rows.collect()] == [("mapper:OMapper", "name")] and mappers.without_stubs(rows).count() == 0


def test_calls_after_an_anonymous_class(spark):
    text = "class A { void m() { new Thread(run) { public void run() { go(); } }.start(); list.map(x -> { f(x); }).get(); } }"
    rows = java.calls(spark.createDataFrame([("A.java", text)], "path string, content string")).where("kind = 'call'").collect()
    assert {r["name"]: r["scope"] for r in rows if r["caller"] == "m"} == {"start": "new Thread(run) { public void run() { go(); } }", "go": "this", "map": "list", "f": "this", "get": "list.map(x -> { f(x); })"}
