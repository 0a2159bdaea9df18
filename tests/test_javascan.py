from sparkloom.sources.javascan import Scanner


def test_plain_calls_are_not_searched_for_type_arguments(monkeypatch):
    """Each call looked back over the whole file, so that a file of n calls took n squared steps."""
    asked = []
    monkeypatch.setattr(Scanner, "generic_call", lambda self, i: asked.append(i) or 0)
    found = Scanner("class A { void m() { " + "f(x); a.g(y); " * 500 + "} }")
    assert len(found.methods[0]["calls"]) == 1000 and not asked


def test_generic_calls_lines_and_text_blocks():
    found = Scanner('class A {\n  String s = """\n  f(\n  """;\n  void m() {\n    a.<T>b(1);\n    /* g(\n */ h();\n  }\n}')
    assert [(c["scope"], c["name"], c["line"]) for c in found.methods[0]["calls"]] == [("a", "b", 6), ("this", "h", 8)]


def test_bodies_are_passed_over_where_calls_are_not_asked_for(monkeypatch):
    """Each token of a body was looked at, though types, annotations and constructor calls alone matter there."""
    asked, at = [], Scanner.at
    monkeypatch.setattr(Scanner, "at", lambda self, i: asked.append(i) or at(self, i))
    text = "class A { void m() {\n" + "x = x + 1;\n" * 2000 + "new B() { int n() { return 1; } };\nclass C {} } }"
    found = Scanner(text, calls=False)
    assert [(m["name"], m["line"]) for m in found.methods] == [("m", 1), ("n", 2002)] and [(t["name"], t["line"]) for t in found.types] == [("A", 1), ("C", 2003)]
    assert len(asked) < 500
