"""What a Java file declares and calls, read off its tokens.

A small helper for `java.scan`, which maps it over the files of a table. Bodies are not parsed as statements: calls,
references and constructor calls are recognised by the tokens around a name, types and members by the nesting of braces.
"""

from __future__ import annotations

import re
from bisect import bisect_left

#: What stands before a token (blanks, comments), and the token; the last one, at the end of the text, is empty.
TOKENS = re.compile(r'''(\s*+(?:(?://[^\n]*|/\*.*?\*/)\s*+)*+)([A-Za-z_][\w$]*|[(){}\[\];,@]|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|[^\W\d][\w$]*|\d[\w.]*|->|::|\.\.\.|[<>=!+\-*/%&|^]=|&&|\|\||\+\+|--|.|\Z)''', re.DOTALL)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "synchronized", "native", "strictfp", "default", "transient", "volatile", "sealed"}
#: Words that stand before a parenthesis without being called.
NO_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "try", "else", "do", "new", "instanceof", "super", "this", "case", "yield"}
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
BRACKETS = OPEN.keys() | CLOSE.keys()
TYPES = {"class", "interface", "enum", "record"}
#: Tokens that end the type and name of a member.
ENDS = {"(", "=", ";", "{", ","}
#: Tokens that say something in a body without a parenthesis after them, those that do where calls are not asked for, and those that branches are counted by.
SAYING, BRANCHING = {"@", "class", "interface", "enum", "::", "new"}, {"{", "}", "while", "if", "for", "catch", "case", "default", "?"}
DECLARING = SAYING - {"::"}
NOTED = BRACKETS | SAYING | BRANCHING
#: Tokens that stand next to what is before them, and ends of tokens that stand next to what follows.
CLOSE_BEHIND, CLOSE_BEFORE = {*".,;()[]>", "<", "...", "::", "++", "--"}, {*".([<@!"}


def _is_name(token: str) -> bool:
    return token[0].isalpha() or token[0] in "_$"


def render(tokens: list[str]) -> str:
    """Tokens as one line: words apart, a blank after commas and around operators."""
    if len(tokens) < 2:
        return "".join(tokens)
    before = out = tokens[0]
    for token in tokens[1:]:
        apart = token not in CLOSE_BEHIND and before[-1] not in CLOSE_BEFORE and before != "::" or before == ","
        out += " " + token if apart else token
        before = token
    return out


class Scanner:
    """The types, methods and branches of one file."""

    def __init__(self, text: str, calls: bool = True):
        """Without `calls` methods have none; declarations are the same."""
        found = TOKENS.findall(text)
        while found and not found[-1][1]:
            found.pop()
        self.gaps, self.tokens = [gap for gap, _ in found], [token for _, token in found]
        self.types, self.methods, self.size, self.wanted, self.known = [], [], len(found), calls, (-1, 1)
        tokens = self.tokens
        self.noted = [i for i, token in enumerate(tokens) if token in NOTED]
        self.declaring = [i for i in self.noted if tokens[i] in DECLARING]
        self.match, stack = {}, []
        for i in self.noted:
            token = tokens[i]
            if token in OPEN:
                stack.append(i)
            elif token in CLOSE and stack and tokens[stack[-1]] == CLOSE[token]:
                self.match[stack[-1]] = i
                self.match[i] = stack.pop()
        self.package = ""
        self.members(0, len(self.tokens), None)

    def line(self, i: int) -> int:
        """The line of the token at i, counted from the one that was asked for before."""
        at, line = self.known
        low, high = min(at, i), max(at, i)
        between = "".join(self.gaps[low + 1 : high + 1]).count("\n") + "".join(self.tokens[max(low, 0) : high]).count("\n")
        line += between if i > at else -between
        self.known = i, line
        return line

    def at(self, i: int) -> str:
        return self.tokens[i] if 0 <= i < self.size else ""

    def after(self, i: int) -> int:
        """The place after the group that opens at i."""
        return self.match.get(i, len(self.tokens) - 1) + 1

    def angles(self, i: int) -> int:
        """The place after the type arguments that open at i; i itself where none do."""
        depth, j = 0, i
        while j < len(self.tokens):
            t = self.at(j)
            depth += (t == "<") - (t == ">")
            if t in "();{}" or t == "&&" or (t == "=" or t == "->"):
                return i
            j += 1
            if not depth:
                return j
        return i

    def annotation(self, i: int) -> tuple[dict, int]:
        """The annotation at i (its @): name, its only value where that is a string, and the place after it."""
        j = i + 2
        while self.at(j) == ".":
            j += 2
        name, value = "".join(self.tokens[i + 1 : j]), None
        if self.at(j) == "(":
            inner, j = self.tokens[j + 1 : self.after(j) - 1], self.after(j)
            value = inner[0][1:-1] if len(inner) == 1 and inner[0][0] == '"' else None
        return {"name": name, "value": value}, j

    def members(self, i: int, end: int, owner: dict | None) -> None:
        """Declarations between i and end; owner is the type around them."""
        marks: list[dict] = []
        while i < end:
            t = self.at(i)
            if t == "@" and self.at(i + 1) != "interface":
                mark, i = self.annotation(i)
                marks.append(mark)
                continue
            if t in MODIFIERS or (t == "non" and self.at(i + 1) == "-"):
                i += 3 if t == "non" else 1
                continue
            if t in ("package", "import") and owner is None:
                stop = next((j for j in range(i, end) if self.at(j) == ";"), end)
                if t == "package":
                    self.package = "".join(self.tokens[i + 1 : stop])
                i = stop + 1
            elif t == "@" or t in TYPES and _is_name(self.at(i + 1) or " ") and self.at(i + 2) not in ("=", ";", ",") and (t != "record" or self.at(i + 2) in ("(", "<")):
                i = self.type(i + (t == "@"), end, marks)
            elif t == "{":
                self.body(i + 1, self.after(i) - 1, owner, [])
                i = self.after(i)
            elif t == "<":
                j = self.angles(i)
                i = j if j > i else i + 1
                continue
            elif owner is not None and _is_name(t):
                i = self.member(i, end, owner, marks)
            else:
                i += 1
            marks = []

    def type(self, i: int, end: int, marks: list[dict]) -> int:
        """The type declared at i (its keyword); returns the place after it."""
        kind, name, line = self.at(i), self.at(i + 1), self.line(i)
        if kind == "interface" and self.at(i - 1) == "@":
            kind = "annotation"
        clauses: dict[str, list[str]] = {"extends": [], "implements": []}
        into, j = None, i + 2
        while j < end and self.at(j) not in ("{", ";"):
            t = self.at(j)
            if t == "<" and (k := self.angles(j)) > j:
                j = k
            elif t == "(":
                j = self.after(j)
            else:
                if t in ("extends", "implements", "permits"):
                    into = clauses.get(t)
                elif into is not None and _is_name(t) and self.at(j + 1) != ".":
                    into.append(t)
                j += 1
        owner = {"name": name, "kind": kind, "line": line, "annotations": [m["name"] for m in marks], **clauses}
        self.types.append(owner)
        if self.at(j) != "{":
            return j + 1
        first, stop = j + 1, self.after(j) - 1
        if kind == "enum":
            first = self.constants(first, stop, owner)
        self.members(first, stop, owner)
        return self.after(j)

    def constants(self, i: int, end: int, owner: dict) -> int:
        """Past an enum's constants; the bodies that some have are read as members."""
        while i < end and self.at(i) != ";":
            if self.at(i) == "{":
                self.members(i + 1, self.after(i) - 1, owner)
            i = self.after(i) if self.at(i) in OPEN else i + 1
        return i + 1

    def member(self, i: int, end: int, owner: dict, marks: list[dict]) -> int:
        """A field, constructor or method that begins at i with its type or name."""
        j, tokens = i, self.tokens
        while j < end and (t := tokens[j]) not in ENDS:
            j = k if t == "<" and (k := self.angles(j)) > j else j + 1
        if self.at(j) != "(" or not _is_name(self.at(j - 1) or " "):
            if self.at(j) == "{":  # a record's compact constructor
                self.body(j + 1, self.after(j) - 1, owner, [])
                return self.after(j)
            start = j
            while j < end and (t := tokens[j]) != ";":
                j = self.after(j) if t in OPEN else j + 1
            self.body(start, j, owner, [])
            return j + 1
        name, returns = self.at(j - 1), render(tokens[i : j - 1])
        params = self.parameters(j + 1, self.after(j) - 1)
        k = self.after(j)
        while k < end and self.at(k) not in ("{", ";"):
            k = self.after(k) if self.at(k) in OPEN else k + 1
        inside, calls = (k + 1, self.after(k) - 1) if self.at(k) == "{" else (k, k), []
        method = {"class_name": owner["name"], "class_annotations": owner["annotations"], "name": name, "return_type": returns, "params": params, "annotations": marks, "line": self.line(i), "has_body": self.at(k) == "{", "body": render(tokens[inside[0] : min(inside[1], inside[0] + 12)]), "calls": calls}
        if returns:  # a constructor has none, and is no method
            self.methods.append(method)
        self.body(*inside, owner, calls)
        return self.after(k) if self.at(k) == "{" else k + 1

    def parameters(self, i: int, end: int) -> list[dict]:
        out, tokens = [], []
        while i <= end:
            t = self.at(i)
            if i == end or t == ",":
                words = tokens[:]
                while words and words[-1] in ("[", "]"):
                    words.pop()
                if len(words) > 1 and words[-1] != "this":
                    out.append({"type": render(words[:-1] + tokens[len(words) :]), "name": words[-1]})
                tokens, i = [], i + 1
            elif t == "@":
                i = self.annotation(i)[1]
            elif t == "final":
                i += 1
            elif t == "<" and (k := self.angles(i)) > i:
                tokens += self.tokens[i:k]
                i = k
            else:
                tokens.append(t)
                i += 1
        return out

    def scope(self, end: int) -> list[str]:
        """The expression that ends before the dot (or ::) at this place."""
        i = end - 1
        while i >= 0:
            if self.at(i) == "}" and self.at(self.match.get(i, i) - 1) == ")":  # an anonymous class
                i = self.match[i] - 1
            if self.at(i) in (")", "]"):
                i = self.match.get(i, i)
                if _is_name(self.at(i - 1) or " ") and self.at(i - 1) not in NO_CALLS - {"this", "super"}:
                    i -= 1
                elif self.at(i) == "[":
                    i -= 1
                    continue
            elif self.at(i) == ">":
                depth = 1
                while depth and i > 0:
                    i -= 1
                    depth += (self.at(i) == ">") - (self.at(i) == "<")
                i -= _is_name(self.at(i - 1) or " ")
            if self.at(i - 1) in (".", "::"):
                i -= 2
            elif self.at(i - 1) == ">" and (dot := self.generic_call(i)):
                i = dot - 1
            elif self.at(i - 1) == "new":
                i -= 1
                if self.at(i - 1) != ".":
                    break
                i -= 2
            else:
                break
        return self.tokens[max(i, 0) : end]

    def body(self, i: int, end: int, owner: dict | None, calls: list[dict]) -> None:
        """The calls between i and end, and the types and anonymous classes declared there."""
        while i < end:
            if not self.wanted:  # what lies between says nothing
                nth = bisect_left(self.declaring, i)
                if nth == len(self.declaring) or (i := self.declaring[nth]) >= end:
                    return
            t, behind = self.tokens[i], self.at(i + 1)
            if behind != "(" and t not in SAYING:
                i += 1
                continue
            before = self.at(i - 1)
            if t == "@" and _is_name(behind or " "):
                i = self.annotation(i)[1]
                continue
            if t in ("class", "interface", "enum") and before != "." and _is_name(behind or " "):
                i = self.type(i, end, [])
                continue
            if t == "::" and self.wanted:
                said = render(self.scope(i))
                calls.append({"kind": "reference", "scope": said, "name": behind, "line": self.line(i), "expression": f"{said}::{behind}"})
            elif t == "new" and before != "::":
                j = i + 1
                while _is_name(self.at(j) or " ") or self.at(j) == ".":
                    j += 1
                if self.at(j) == "<":
                    j = self.angles(j)
                if self.at(j) == "(":
                    if self.wanted:
                        made = render(self.tokens[i + 1 : j])
                        calls.append({"kind": "new", "scope": made.rsplit(".", 1)[-1] if "<" not in made else made, "name": "<init>", "line": self.line(i), "expression": f"new {made}(..)"})
                    if self.at(self.after(j)) == "{" and owner is not None:
                        inner = self.after(j)
                        self.body(j + 1, inner - 1, owner, calls)
                        first = len(self.methods)
                        self.members(inner + 1, self.after(inner) - 1, owner)
                        for method in self.methods[first:]:
                            calls += method["calls"]
                        i = self.after(inner)
                        continue
                    i = j + 1
                    continue
            elif self.wanted and behind == "(" and _is_name(t) and t not in NO_CALLS and before not in ("new", "instanceof", "case"):
                dot = i - 1 if before == "." else self.generic_call(i) if before == ">" else 0
                said = self.scope(dot) if dot else []
                scope = render(said) or "this"
                calls.append({"kind": "call", "scope": scope, "name": t, "line": self.line(i - len(said) - 1 if said else i), "expression": render([*said, "."] if said else []) + render(self.tokens[i : self.after(i + 1)])})
            i += 1

    def generic_call(self, i: int) -> int:
        """The place of the dot before type arguments that end before i, as in a.<T>b(); 0 without one."""
        tokens, depth, j = self.tokens, 1, i - 1
        while depth and j > 0:
            j -= 1
            depth += (tokens[j] == ">") - (tokens[j] == "<")
        return j - 1 if self.at(j - 1) == "." else 0

    def branches(self) -> int:
        """if, for, while (none of do), catch, switch entries and conditional expressions."""
        count, stack, closed_do = 0, [], False
        for i in self.noted:
            t = self.tokens[i]
            if t == "{":
                stack.append(self.at(i - 1) == "do")
            elif t == "}":
                closed_do = bool(stack) and stack.pop()
            elif t == "while":
                count += not (closed_do and self.at(i - 1) == "}")
            elif t in ("if", "for", "catch", "case") or t == "default" and self.at(i + 1) in (":", "->"):
                count += self.at(i - 1) != "."
            elif t == "?":
                count += not (self.at(i - 1) in ("<", ",") and self.at(i + 1) in (">", ",", "extends", "super"))
        return count
