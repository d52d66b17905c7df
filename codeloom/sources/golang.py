"""A parser of Go source for facts: definitions, references, imports, with byte spans.

A scanner with automatic semicolons, and a recursive descent over declarations, statements and
expressions. On a syntax error the top-level declaration that has it is dropped, with its
references, and the file is partial; the others stay. The work is bounded by steps (tokens read, and looked
ahead at), so that a file has the same facts on any machine.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import numpy as np

#: Steps that a file may take: more than twice the tokens that a file of the largest parsed size can hold.
BUDGET = 4 << 20
#: Nested statements, expressions and types, each of some calls.
DEPTH = 400
KEYWORDS = frozenset("func type var const import package struct interface map chan if else for range switch case default select go defer return break continue goto fallthrough".split())
#: Predeclared names, types first.
UNIVERSE = frozenset(
    "int uint string bool error byte rune any float64 float32 int64 int32 int16 int8 uint64 uint32 uint16 uint8 uintptr complex64 complex128 comparable "
    "nil true false iota len cap make new append copy delete panic recover print println close clear complex real imag max min".split()
)
_ENDS = frozenset(["break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_OPS = ["<<=", ">>=", "&^=", "...", "&&", "||", "<-", "++", "--", "==", "!=", "<=", ">=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<", ">>", "&^"]
_TOKEN = re.compile(
    r"[ \t\r]*+(?:(?P<name>[^\W\d]\w*)|(?P<nl>\n)|(?P<line>//[^\n]*)|(?P<block>/\*.*?\*/)|(?P<num>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?[0-9_]+)?|0[bB][01_]+|0[oO][0-7_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?)i?)"
    r'|(?P<str>"(?:\\.|[^"\\\n])*")|(?P<raw>`[^`]*`)|(?P<char>\'(?:\\[^\n]+?|[^\'\\\n])\')|(?P<op>' + "|".join(map(re.escape, _OPS)) + r"|[-+*/%&|^<>=!()\[\]{},;.:~])|(?P<bad>.)|(?P<end>\Z))",
    re.DOTALL,
)
_BINARY = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_UNARY = frozenset("+ - ! ^ * & <- ~".split())


class SyntaxProblem(Exception):
    pass


class OutOfSteps(Exception):
    pass


@dataclass(slots=True, eq=False)
class Token:
    kind: str  # name, keyword, num, str, op, eof, bad
    text: str
    start: int  # character offsets
    end: int
    auto: bool = False


@dataclass(slots=True, eq=False)
class Comment:
    text: str
    start: int
    end: int
    row: int
    end_row: int


@dataclass
class File:
    package_name: str | None = None
    defs: list[dict] = field(default_factory=list)
    refs: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    status: str = "ok"


class _Scanner:
    def __init__(self, src: str, budget: int) -> None:
        self.src, self.tokens, self.comments = src, [], []
        self.bad: list[int] = []  # places of tokens that are no Go
        self.lines = [0, *(m.end() for m in re.finditer("\n", src))]
        tokens, last = self.tokens, None

        def auto(pos: int) -> None:
            nonlocal last
            if last is not None and (last.kind in ("name", "num", "str") or last.text in _ENDS):
                tokens.append(Token("op", ";", pos, pos, True))
            last = None

        for m in _TOKEN.finditer(src):
            kind = m.lastgroup
            if kind == "end":
                break
            start, end = m.span(m.lastindex)
            if kind == "nl":
                auto(start)
                continue
            text = src[start:end]
            if kind == "line":
                text = text.rstrip("\r")
                self.comments.append(Comment(text, start, start + len(text), self.row(start), self.row(end - 1)))
            elif kind == "block":
                self.comments.append(Comment(text, start, end, self.row(start), self.row(end - 1)))
                if "\n" in text:
                    auto(start)
            else:
                if kind == "name":
                    if text in KEYWORDS:
                        kind = "keyword"
                elif kind != "op":
                    if kind == "bad":
                        self.bad.append(len(tokens))
                    kind = "str" if kind == "raw" else "num" if kind == "char" else kind
                last = Token(kind, text, start, end)
                tokens.append(last)
                if len(tokens) > budget:
                    raise OutOfSteps
        auto(len(src))
        tokens.append(Token("eof", "", len(src), len(src)))

    def row(self, at: int) -> int:
        return bisect_right(self.lines, at) - 1


@dataclass(slots=True, eq=False)
class _Ref:
    kind: str
    token: Token
    qualifier: str | None = None


class _Parser:
    """refs collects every reference; declared the positions of names that declare something."""

    def __init__(self, src: str, budget: int) -> None:
        self.src = src
        self.scan = _Scanner(src, budget)
        self.tokens, self.last = self.scan.tokens, len(self.scan.tokens) - 1
        self.go(0)
        self.left = budget - len(self.tokens)
        self.refs: list[_Ref] = []
        self.bodies: list[tuple[int, int]] = []  # of function literals, for signatures
        self.depth = 0

    # tokens
    def go(self, at: int) -> None:
        self.at, self.tok = at, self.tokens[at]

    def peek(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, self.last)]

    def next(self) -> Token:
        t = self.tok
        self.left -= 1
        if self.left < 0:
            raise OutOfSteps
        if self.at < self.last:
            self.at += 1
            self.tok = self.tokens[self.at]
        return t

    def spend(self, steps: int) -> None:
        self.left -= steps
        if self.left < 0:
            raise OutOfSteps

    def got(self, text: str) -> Token | None:
        # No name, number or string has the text of an operator or a keyword.
        return self.next() if self.tok.text == text else None

    def want(self, text: str) -> Token:
        t = self.got(text)
        if t is None:
            raise SyntaxProblem(f"{text} expected at {self.tok.start}")
        return t

    def name(self) -> Token:
        if self.tok.kind != "name":
            raise SyntaxProblem(f"a name expected at {self.tok.start}")
        return self.next()

    def is_op(self, *texts: str) -> bool:
        return self.tok.text in texts

    # references
    def use(self, token: Token) -> _Ref:
        ref = _Ref("name_ref", token)
        self.refs.append(ref)
        return ref

    def drop(self, ref: _Ref | None) -> None:
        if ref is not None and ref in self.refs[-64:]:
            for k in range(len(self.refs) - 1, -1, -1):
                if self.refs[k] is ref:
                    del self.refs[k]
                    break

    # types
    def type_name(self) -> tuple[str, str]:
        t = self.name()
        if self.is_op(".") and self.peek().kind == "name":
            self.next()
            member = self.name()
            self.refs.append(_Ref("type_ref", member, t.text))
            shape = "qualified"
        else:
            self.refs.append(_Ref("type_ref", t))
            shape = "named"
        if self.is_op("[") and not (self.peek().text == "]"):
            self.next()
            self.type_list("]")
            self.want("]")
            shape = "generic"
        return shape, t.text

    def type_list(self, close: str) -> None:
        while not self.is_op(close):
            self.type_()
            if not self.got(","):
                break

    def starts_type(self) -> bool:
        t = self.tok
        return t.kind == "name" or (t.kind == "keyword" and t.text in ("struct", "interface", "map", "chan", "func")) or (t.kind == "op" and t.text in ("*", "[", "(", "<-", "~"))

    def type_(self) -> str:
        """Parses a type and says its shape, which decides whether keys of its literals are fields."""
        self.depth += 1
        if self.depth > DEPTH:
            raise SyntaxProblem("too deep")
        try:
            t = self.tok
            if t.kind == "name":
                return self.type_name()[0]
            if self.got("*"):
                inner = self.type_()
                return "fields" if inner in ("named", "qualified", "struct", "generic", "fields") else "other"
            if self.got("("):
                inner = self.type_()
                self.want(")")
                return inner
            if self.got("["):
                if self.got("]"):
                    inner = self.type_()
                    return "fields" if inner in ("named", "qualified", "struct", "generic", "fields") else "other"
                if not self.got("..."):
                    self.expr()
                self.want("]")
                inner = self.type_()
                return "fields" if inner in ("named", "qualified", "struct", "generic", "fields") else "other"
            if self.got("map"):
                self.want("[")
                self.type_()
                self.want("]")
                self.type_()
                return "map"
            if self.got("chan"):
                self.got("<-")
                self.type_()
                return "other"
            if self.is_op("<-") and self.peek().text == "chan":
                self.next()
                self.next()
                self.type_()
                return "other"
            if self.got("func"):
                self.signature()
                return "func"
            if self.got("struct"):
                self.struct_body()
                return "struct"
            if self.got("interface"):
                self.interface_body()
                return "interface"
            raise SyntaxProblem(f"a type expected at {t.start}")
        finally:
            self.depth -= 1

    def struct_body(self) -> None:
        self.want("{")
        while not self.is_op("}"):
            if self.is_op("*", "("):
                self.type_()
            elif self.tok.kind == "name" and (self.peek().text in (";", "}", ".") or self.peek().kind == "str"):
                self.type_name()  # embedded
            elif self.tok.kind == "name" and self.peek().text == "[" and self.embedded_generic():
                self.type_name()
            else:
                # Field names are field identifiers: they refer like any other.
                while True:
                    self.refs.append(_Ref("field_name", self.name()))
                    if not self.got(","):
                        break
                self.type_()
            if self.tok.kind == "str":
                self.next()
            if not self.got(";"):
                break
        self.want("}")

    def embedded_generic(self) -> bool:
        """Whether name [ … ] is an embedded generic type and not a field of array type."""
        k, depth = self.at + 1, 0
        while k < len(self.tokens):
            text = self.tokens[k].text
            depth += (text == "[") - (text == "]")
            if depth == 0:
                self.spend(k - self.at)
                after = self.tokens[k + 1] if k + 1 < len(self.tokens) else None
                return after is not None and (after.text in (";", "}") or after.kind == "str") and k > self.at + 2
            k += 1
        self.spend(k - self.at)
        return False

    def interface_body(self) -> None:
        self.want("{")
        while not self.is_op("}"):
            if self.tok.kind == "name" and self.peek().text == "(":
                self.refs.append(_Ref("field_name", self.name()))
                self.signature()
            else:
                self.union()
            if not self.got(";"):
                break
        self.want("}")

    def union(self) -> None:
        while True:
            self.got("~")
            self.type_()
            if not self.got("|"):
                return

    def signature(self) -> None:
        self.parameters()
        if self.is_op("("):
            self.parameters()
        elif self.starts_type() and not self.is_op("~"):
            self.type_()

    def parameters(self) -> None:
        """Names are declared only when an entry has a name and a type."""
        self.want("(")
        entries: list[tuple[Token | None, int, int]] = []
        named = False
        while not self.is_op(")"):
            first, mark = self.tok, len(self.refs)
            if self.got("..."):
                self.type_()
                entries.append((None, mark, len(self.refs)))
            elif first.kind == "name":
                follows = self.peek()
                if follows.text in (",", ")"):
                    self.next()
                    self.refs.append(_Ref("type_ref", first))
                    entries.append((first, mark, len(self.refs)))
                elif follows.text == ".":
                    self.type_()
                    entries.append((None, mark, len(self.refs)))
                elif follows.text == "[" and self.generic_type_ahead():
                    self.type_()
                    entries.append((None, mark, len(self.refs)))
                else:
                    self.next()
                    self.got("...")
                    self.type_()
                    named = True
                    entries.append((None, mark, len(self.refs)))
            else:
                self.type_()
                entries.append((None, mark, len(self.refs)))
            if not self.got(","):
                break
        self.want(")")
        if named:  # then lone names are names too
            lone = {id(self.refs[m]) for name, m, _ in entries if name is not None}
            if lone:
                base = entries[0][1]
                self.refs[base:] = [r for r in self.refs[base:] if id(r) not in lone]

    def generic_type_ahead(self) -> bool:
        """In parameters: name [ … ] followed by a comma or the end is a generic type, else a name and an array type."""
        k, depth = self.at + 1, 0
        while k < len(self.tokens):
            text = self.tokens[k].text
            depth += (text == "[") - (text == "]")
            if depth == 0:
                self.spend(k - self.at)
                return self.tokens[k + 1].text in (",", ")") and k > self.at + 2
            k += 1
        self.spend(k - self.at)
        return False

    def type_parameters(self) -> None:
        self.want("[")
        while not self.is_op("]"):
            while True:
                self.name()
                if not self.got(","):
                    break
            self.union()
            if not self.got(","):
                break
        self.want("]")

    # expressions
    def expr(self, brace: bool = True) -> _Ref | None:
        """Parses one; returns its reference when it is a lone name. brace: whether a literal may follow a type name."""
        self.depth += 1
        if self.depth > DEPTH:
            raise SyntaxProblem("too deep")
        try:
            lone = self.unary(brace)
            while self.tok.kind == "op" and self.tok.text in _BINARY:
                self.next()
                self.unary(brace)
                lone = None
            return lone
        finally:
            self.depth -= 1

    def unary(self, brace: bool) -> _Ref | None:
        if self.tok.kind == "op" and self.tok.text in _UNARY:
            if self.tok.text == "<-" and self.peek().text == "chan":
                self.type_()
                return None
            self.next()
            self.unary(brace)
            return None
        return self.primary(brace)

    def primary(self, brace: bool) -> _Ref | None:
        t = self.tok
        lone: _Ref | None = None
        last: _Ref | None = None  # the selector that a call would call
        shape = ""
        if t.kind in ("num", "str"):
            self.next()
        elif t.kind == "name":
            lone = self.use(self.next())
            shape = "named"
        elif self.got("("):
            if self.starts_type() and not self.tok.kind == "name" and not self.is_op("*", "(", "<-"):
                self.type_or_expr()
            else:
                self.expr()
            self.want(")")
        elif self.is_op("func"):
            self.next()
            self.signature()
            if self.is_op("{"):
                begin = self.tok.start
                self.block()
                self.bodies.append((begin, self.tokens[self.at - 1].end))
        elif self.is_op("[", "struct", "map", "interface", "chan"):
            shape = self.type_()
            if self.is_op("{"):
                self.literal(shape in ("struct", "fields"))
                shape = ""
        else:
            raise SyntaxProblem(f"an expression expected at {t.start}")
        while True:
            if self.is_op("."):
                self.next()
                if self.got("("):
                    if not self.got("type"):
                        self.type_()
                    self.want(")")
                    lone, last, shape = None, None, ""
                    continue
                member = self.name()
                qualifier = None
                if lone is not None:
                    qualifier = lone.token.text
                    self.drop(lone)
                    shape = "qualified" if shape == "named" else ""
                else:
                    shape = ""
                last = _Ref("field_ref", member, qualifier)
                self.refs.append(last)
                lone = None
            elif self.is_op("("):
                if last is not None:
                    last.kind = "call_ref"
                self.arguments()
                lone, last, shape = None, None, ""
            elif self.is_op("["):
                mark = len(self.refs)
                self.next()
                was = shape
                self.index()
                self.want("]")
                shape = "generic" if was in ("named", "qualified") and not self._sliced else ""
                if self.is_op("{") and brace and shape == "generic":
                    self.as_types(mark)
                lone = None
            elif self.is_op("{") and brace and shape in ("named", "qualified", "generic"):
                if lone is not None:
                    lone.kind = "type_ref"
                if last is not None and shape in ("qualified", "generic"):
                    last.kind = "type_ref"
                self.literal(True)
                lone, last, shape = None, None, ""
            else:
                return lone

    def as_types(self, mark: int) -> None:
        for r in self.refs[mark:]:
            if r.kind == "name_ref":
                r.kind = "type_ref"
        if mark and self.refs[mark - 1].kind in ("name_ref",):
            self.refs[mark - 1].kind = "type_ref"

    _sliced = False

    def index(self) -> None:
        self._sliced = False
        sliced = False
        while not self.is_op("]"):
            if self.got(":"):
                sliced = True
                continue
            self.type_or_expr()
            if self.got(","):
                continue
            if not self.is_op(":"):
                break
        self._sliced = sliced

    def type_or_expr(self) -> None:
        if self.is_op("[", "map", "chan", "struct", "interface") or (self.is_op("func")):
            self.primary(True)
            while self.tok.kind == "op" and self.tok.text in _BINARY:
                self.next()
                self.unary(True)
            return
        self.expr()

    def arguments(self) -> None:
        self.want("(")
        while not self.is_op(")"):
            self.type_or_expr()
            self.got("...")
            if not self.got(","):
                break
        self.want(")")

    def literal(self, fields: bool) -> None:
        """Elements of a composite literal; lone keys of struct-shaped types declare nothing and refer to nothing."""
        self.want("{")
        while not self.is_op("}"):
            if self.is_op("{"):
                self.literal(fields)
            else:
                lone = self.expr()
                if self.is_op(":"):
                    if fields:
                        self.drop(lone)
                    self.next()
                    if self.is_op("{"):
                        self.literal(fields)
                    else:
                        self.expr()
                    if not self.got(","):
                        break
                    continue
            if self.got(":"):
                if self.is_op("{"):
                    self.literal(fields)
                else:
                    self.expr()
            if not self.got(","):
                break
        self.want("}")

    # statements
    def block(self) -> None:
        self.want("{")
        self.statements("}")
        self.want("}")

    def statements(self, *ends: str) -> None:
        while not self.is_op(*ends) and self.tok.kind != "eof":
            self.statement()
            if self.is_op(*ends):
                return
            if not self.got(";"):
                raise SyntaxProblem(f"; expected at {self.tok.start}")

    def statement(self) -> None:
        self.depth += 1
        if self.depth > DEPTH:
            raise SyntaxProblem("too deep")
        try:
            t = self.tok
            if t.kind == "op" and t.text == ";":
                return
            if t.kind == "keyword":
                if t.text in ("var", "const", "type"):
                    self.declaration(False)
                elif self.got("return"):
                    if not self.is_op(";", "}"):
                        self.expressions()
                elif self.got("go") or self.got("defer"):
                    self.expr()
                elif t.text in ("break", "continue", "goto", "fallthrough"):
                    self.next()
                    if self.tok.kind == "name":
                        self.refs.append(_Ref("label", self.next()))
                elif self.got("if"):
                    self.if_()
                elif self.got("for"):
                    self.for_()
                elif self.got("switch"):
                    self.switch()
                elif self.got("select"):
                    self.want("{")
                    while self.is_op("case", "default"):
                        if self.got("case"):
                            self.simple()
                        else:
                            self.next()
                        self.want(":")
                        self.statements("case", "default", "}")
                    self.want("}")
                else:
                    self.simple()
            elif self.is_op("{"):
                self.block()
            elif t.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
                self.next()
                self.next()
                if not self.is_op("}"):
                    self.statement()
            else:
                self.simple()
        finally:
            self.depth -= 1

    def expressions(self, brace: bool = True) -> list[_Ref | None]:
        out = [self.expr(brace)]
        while self.got(","):
            out.append(self.expr(brace))
        return out

    def simple(self, brace: bool = True) -> bool:
        """A simple statement; true when it is a range clause."""
        if self.got("range"):
            self.expr(brace)
            return True
        left = self.expressions(brace)
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            op = self.next().text
            if op == ":=":
                for ref in left:
                    self.drop(ref)
            if self.got("range"):
                self.expr(brace)
                return True
            self.expressions(brace)
        elif self.got("<-"):
            self.expr(brace)
        elif self.is_op("++", "--"):
            self.next()
        return False

    def if_(self) -> None:
        if not self.is_op("{", ";"):
            self.simple(False)
        if self.got(";") and not self.is_op("{"):
            self.simple(False)
        self.block()
        if self.got("else"):
            if self.got("if"):
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        if not self.is_op("{"):
            ranged = False
            if not self.is_op(";"):
                ranged = self.simple(False)
            if not ranged and self.got(";"):
                if not self.is_op(";"):
                    self.simple(False)
                self.want(";")
                if not self.is_op("{"):
                    self.simple(False)
        self.block()

    def switch(self) -> None:
        if not self.is_op("{"):
            if not self.is_op(";"):
                self.simple(False)
            if self.got(";") and not self.is_op("{"):
                self.simple(False)
        by_type = self.tokens[self.at - 2].text == "type" and self.tokens[self.at - 1].text == ")"
        self.want("{")
        while self.is_op("case", "default"):
            if self.got("case"):
                while True:
                    if by_type:
                        if self.tok.kind == "name" and self.tok.text == "nil":
                            self.next()
                        else:
                            self.type_()
                    else:
                        self.type_or_expr()
                    if not self.got(","):
                        break
            else:
                self.next()
            self.want(":")
            self.statements("case", "default", "}")
        self.want("}")

    # declarations
    def declaration(self, top: bool) -> list[dict]:
        """One var, const or type declaration, grouped or not; top-level specs come back as definitions."""
        keyword = self.next()
        out: list[dict] = []
        if self.got("("):
            while not self.is_op(")"):
                out += self.spec(keyword, keyword.start, True)
                if not self.got(";"):
                    break
            self.want(")")
        else:
            out += self.spec(keyword, keyword.start, False)
        return out

    def spec(self, keyword: Token, decl: int, grouped: bool) -> list[dict]:
        start, mark = self.tok.start, len(self.bodies)
        if keyword.text == "type":
            name = self.name()
            params = (0, 0)
            if self.is_op("[") and self.peek().kind == "name" and self.type_params_ahead():
                begin = self.tok.start
                self.type_parameters()
                params = (begin, self.tokens[self.at - 1].end)
            alias = bool(self.got("="))
            shape = self.type_()
            kind = "type" if alias or shape not in ("struct", "interface") else shape
            end = self.tokens[self.at - 1].end
            generics = _ws(self.src[params[0] : params[1]])
            if kind in ("struct", "interface"):
                signature = f"type {name.text}{generics} {kind} {{ … }}"
            else:
                signature = f"type {_ws(self.src[start:end])}"
            return [{"name": name.text, "kind": kind, "start": start, "end": end, "decl": decl, "grouped": grouped, "signature": signature, "container": None}]
        names = [self.name()]
        while self.got(","):
            names.append(self.name())
        if not self.is_op("=", ";", ")"):
            self.type_()
        if self.got("="):
            self.expressions()
        end = self.tokens[self.at - 1].end
        signature = f"{keyword.text} {self.elided(start, end, mark)}"
        return [{"name": n.text, "kind": keyword.text, "start": start, "end": end, "decl": decl, "grouped": grouped, "signature": signature, "container": None} for n in names]

    def type_params_ahead(self) -> bool:
        """After a type's name: [ name constraint is a parameter list, [ n ] an array type."""
        a, b = self.peek(1), self.peek(2)
        return a.kind == "name" and (b.kind == "name" or b.text in (",", "interface", "~", "*", "[", "func", "map", "chan", "(") or b.kind == "keyword") and b.text != "]"

    def elided(self, start: int, end: int, mark: int) -> str:
        out, pos = [], start
        for a, b in sorted(self.bodies[mark:]):
            if a >= pos:
                out += [self.src[pos:a], "…"]
                pos = b
        return _ws("".join([*out, self.src[pos:end]]))

    def function(self) -> dict:
        keyword = self.want("func")
        container = None
        if self.is_op("("):
            begin = self.at
            self.parameters()
            container = self.receiver(begin)
        name = self.name()
        if container is None and self.tokens[self.at - 2].text == ")":
            container = ""
        if self.is_op("["):
            self.type_parameters()
        self.signature()
        end = self.tokens[self.at - 1].end
        header = self.src[keyword.start : self.tok.start if self.is_op("{") else end]
        if self.is_op("{"):
            self.block()
            end = self.tokens[self.at - 1].end
        method = container is not None
        if method:
            self.refs.append(_Ref("field_name", name))
        return {"name": name.text, "kind": "method" if method else "func", "start": keyword.start, "end": end, "decl": keyword.start, "grouped": False, "signature": _ws(header), "container": container or None}

    def receiver(self, begin: int) -> str | None:
        """The base type's name, without pointer and parameters."""
        texts = [t for t in self.tokens[begin + 1 : self.at - 1] if t.text not in ("*", "(", ")")]
        names = []
        for t in texts:
            if t.text == "[":
                break
            if t.kind == "name":
                names.append(t.text)
        return names[-1] if names else None

    def import_(self) -> list[dict]:
        self.want("import")
        out = []

        def one() -> None:
            start, alias = self.tok.start, None
            if self.tok.kind == "name" or self.is_op("."):
                alias = self.next().text
            if self.tok.kind != "str":
                raise SyntaxProblem("an import path expected")
            path = self.next()
            out.append({"raw": path.text.strip("\"`"), "alias": alias, "kind": "import", "start": start, "end": path.end})

        if self.got("("):
            while not self.is_op(")"):
                one()
                if not self.got(";"):
                    break
            self.want(")")
        else:
            one()
        return out

    def recover(self, begin: int) -> None:
        """To the next top-level declaration: a keyword at the beginning of a line."""
        self.go(max(self.at, begin))
        while self.tok.kind != "eof":
            t = self.tok
            if self.at > begin and t.kind == "keyword" and t.text in ("func", "type", "var", "const", "import") and self.src[max(0, t.start - 1) : t.start] in ("\n", ""):
                return
            self.go(self.at + 1)


def _ws(s: str) -> str:
    return " ".join(s.split())


class _Docs:
    """Comments above a declaration. As they count by rows alone, one that ends the line before is a comment above, too."""

    def __init__(self, scan: _Scanner, bodies: list[tuple[int, int]]) -> None:
        self.scan, self.src, self.bodies = scan, scan.src, bodies
        self.ends = [c.end for c in scan.comments]

    def of(self, start: int) -> str | None:
        """First paragraph of the comments right above; compiler directives are looked through."""
        k = bisect_right(self.ends, start) - 1
        block: list[Comment] = []
        row = self.scan.row(start)
        while k >= 0:
            c = self.scan.comments[k]
            j = bisect_right(self.bodies, (c.start, len(self.src))) - 1
            if c.end_row != row - 1 or (j >= 0 and c.start < self.bodies[j][1]):
                break
            block.append(c)
            row = c.row
            k -= 1
        kept = [c for c in reversed(block) if not c.text.lstrip().startswith("//go:")]
        if not kept:
            return None
        lines: list[str] = []
        for c in kept:
            if c.text.startswith("/*"):
                for x in c.text[2:-2].splitlines():
                    x = x.lstrip()
                    lines.append(x[2:] if x.startswith("* ") else x)
            else:
                rest = c.text[2:]
                lines.append(rest[1:] if rest.startswith(" ") else rest)
        paragraph: list[str] = []
        for x in lines:
            if x.strip():
                paragraph.append(x.rstrip())
            elif paragraph:
                break
        return "\n".join(paragraph) or None


def parse(source: bytes, budget: int = BUDGET) -> File:
    """Facts of one file; never raises. Out of steps: status timeout and no facts. Bytes that are no UTF-8 keep their place in offsets."""
    src = source.decode("utf-8", errors="surrogateescape")
    out = File()
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20 * DEPTH))
    try:
        _file(_Parser(src, budget), out)
    except OutOfSteps:
        return File(status="timeout")
    finally:
        sys.setrecursionlimit(limit)
    return out


def _shown(text: str | None) -> str | None:
    """Text that may be stored: bytes that are no UTF-8 become the replacement character."""
    return text if text is None or text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _file(p: _Parser, out: File) -> None:
    scan, defs, imports, kept, dropped = p.scan, [], [], [], []
    if scan.bad:
        out.status = "partial"
    while p.got(";"):
        pass
    if p.is_op("package"):
        p.next()
        try:
            out.package_name = p.name().text
            if not p.got(";") and p.tok.kind != "eof":
                raise SyntaxProblem("; expected")
        except SyntaxProblem:
            out.status = "partial"
            p.recover(p.at)
    elif p.tok.kind != "eof":
        out.status = "partial"
        if not (p.tok.kind == "keyword" and p.tok.text in ("func", "type", "var", "const", "import")):
            p.recover(p.at)
    while p.tok.kind != "eof":
        begin, p.refs, p.depth = p.at, [], 0
        try:
            found: list[dict] = []
            got: list[dict] = []
            if p.is_op("import"):
                got = p.import_()
            elif p.is_op("func"):
                found = [p.function()]
            elif p.is_op("var", "const", "type"):
                found = p.declaration(True)
            elif p.got(";"):
                continue
            else:
                raise SyntaxProblem("a declaration expected")
            if p.tok.kind != "eof" and not p.got(";"):
                raise SyntaxProblem("; expected")
            if scan.bad and bisect_left(scan.bad, begin) < bisect_left(scan.bad, p.at):
                raise SyntaxProblem("a character that is no Go")
            defs += found
            imports += got
            kept += p.refs
        except (SyntaxProblem, RecursionError):
            out.status = "partial"
            dropped.append(begin)
            p.recover(begin + 1)
    offsets, lines = _Bytes(p.src), scan.lines
    docs = _Docs(scan, [(d["start"], d["end"]) for d in defs if d["kind"] in ("func", "method")])

    def span(start: int, end: int) -> dict:
        line = bisect_right(lines, start)
        last = line if line == len(lines) or end <= lines[line] else bisect_right(lines, end - 1)
        return {"start_line": line, "end_line": last, "start_byte": offsets.of(start), "end_byte": offsets.of(end)}

    for d in defs:
        if d["name"] == "_":
            continue
        doc = docs.of(d["start"])
        out.defs.append({"name": d["name"], "qual_name": f"{d['container']}.{d['name']}" if d["container"] else d["name"], "kind": d["kind"], **span(d["start"], d["end"]), "container": d["container"], "exported": d["name"][:1].isupper(), "signature": _shown(d["signature"]), "doc": _shown(doc)})
    out.defs.sort(key=lambda d: (d["start_byte"], d["end_byte"], d["name"]))
    out.imports = [{"raw": _shown(i["raw"]), "alias": i["alias"], "kind": i["kind"], **span(i["start"], i["end"])} for i in imports]
    out.imports.sort(key=lambda i: (i["start_byte"], i["raw"]))
    starts = [d["start_byte"] for d in out.defs]
    for r in kept:
        name = r.token.text
        if r.kind in ("field_name", "label") or (r.kind == "name_ref" and (name == "_" or name in UNIVERSE)) or (r.kind == "type_ref" and name in UNIVERSE and r.qualifier is None):
            continue
        at = span(r.token.start, r.token.end)
        k = bisect_right(starts, at["start_byte"]) - 1
        holder = out.defs[k] if k >= 0 and out.defs[k]["end_byte"] >= at["end_byte"] else None
        out.refs.append({"name": name, "kind": r.kind, "qualifier": r.qualifier, **at, "container": holder["qual_name"] if holder else None})
    out.refs.sort(key=lambda r: (r["start_byte"], r["end_byte"], r["name"]))


class _Bytes:
    """Byte offsets of character offsets."""

    def __init__(self, src: str) -> None:
        self.ascii = src.isascii()
        if not self.ascii:
            c = np.frombuffer(src.encode("utf-32-le", "surrogatepass"), np.uint32)
            n = 1 + (c >= 0x80).astype(np.int64) + (c >= 0x800) + (c >= 0x10000)
            n[(c >= 0xDC80) & (c <= 0xDCFF)] = 1  # a byte that is no UTF-8
            self.at = [0, *np.cumsum(n).tolist()]

    def of(self, k: int) -> int:
        return k if self.ascii else self.at[k]
