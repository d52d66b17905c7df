"""The Go parser by the rules: what declares, what refers, what documents, and what is dropped."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.sources.golang import parse


def go(body, **more):
    return parse(b"package p\n" + body.encode(), **more)


def refs(body):
    return [(r["name"], r["kind"], r["qualifier"]) for r in go(body).refs]


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("func F() {}", [("F", "func", True, "func F()")]),
        ("func (s *Set[T]) Add(x T) bool { return true }", [("Add", "method", True, "func (s *Set[T]) Add(x T) bool")]),
        ("type A struct { x int }", [("A", "struct", True, "type A struct { … }")]),
        ("type a interface { M() }", [("a", "interface", False, "type a interface { … }")]),
        ("type L[T any] []T", [("L", "type", True, "type L[T any] []T")]),
        ("type M = map[string]int", [("M", "type", True, "type M = map[string]int")]),
        ("const (\n\tX = iota\n\tY\n)", [("X", "const", True, "const X = iota"), ("Y", "const", True, "const Y")]),
        ("var f, g = func() int { return 1 }, 2", [("f", "var", False, "var f, g = func() int …, 2"), ("g", "var", False, "var f, g = func() int …, 2")]),
        ("var _ = 1", []),
        ("type Ärger struct{}", [("Ärger", "struct", True, "type Ärger struct { … }")]),
        ("type arr [4]int", [("arr", "type", False, "type arr [4]int")]),
    ],
)
def test_definitions(body, expected):
    got = go(body)
    assert got.status == "ok"
    assert [(d["name"], d["kind"], d["exported"], d["signature"]) for d in got.defs] == expected


def test_method_container():
    (d,) = go("func (s *Set) Add() {}").defs
    assert (d["container"], d["qual_name"]) == ("Set", "Set.Add")


@pytest.mark.parametrize(
    ("body", "expected"),
    [
        ("func f(a T, b *pkg.U) V { return g(a) }", [("T", "type_ref", None), ("U", "type_ref", "pkg"), ("V", "type_ref", None), ("g", "name_ref", None), ("a", "name_ref", None)]),
        ("func f() { x := pkg.Call(1); x.field.deep() }", [("Call", "call_ref", "pkg"), ("field", "field_ref", "x"), ("deep", "call_ref", None)]),
        ("var v = T{key: val, other: w}", [("T", "type_ref", None), ("val", "name_ref", None), ("w", "name_ref", None)]),
        ("var m = map[string]int{k: v}", [("k", "name_ref", None), ("v", "name_ref", None)]),
        ("var v = pkg.T{a: b}", [("T", "type_ref", "pkg"), ("b", "name_ref", None)]),
        ("func f() { for i, x := range xs { use(i, x) } }", [("xs", "name_ref", None), ("use", "name_ref", None), ("i", "name_ref", None), ("x", "name_ref", None)]),
        ("func f() { switch y := x.(type) { case *T: _ = y } }", [("x", "name_ref", None), ("T", "type_ref", None), ("y", "name_ref", None)]),
        ("func f() { G[int](x) ; h.K[U](y) }", [("G", "name_ref", None), ("x", "name_ref", None), ("K", "call_ref", "h"), ("U", "name_ref", None), ("y", "name_ref", None)]),
        ("func f() { if a := b(); a { } }", [("b", "name_ref", None), ("a", "name_ref", None)]),
        ("func f() { L: for { break L } }", []),
        ("func f() { len(x); append(y, nil, true) }", [("x", "name_ref", None), ("y", "name_ref", None)]),
    ],
)
def test_references(body, expected):
    assert refs(body) == expected


def test_imports():
    got = go('import (\n\t"fmt"\n\tm "math/rand"\n\t. "dot"\n\t_ `blank`\n)').imports
    assert [(i["raw"], i["alias"]) for i in got] == [("fmt", None), ("math/rand", "m"), ("dot", "."), ("blank", "_")]


@pytest.mark.parametrize(
    ("body", "doc"),
    [
        ("// F does.\n// More.\n//\n// Later.\nfunc F() {}", "F does.\nMore."),
        ("// F does.\n\nfunc F() {}", None),
        ("// F does.\n//go:noinline\nfunc F() {}", "F does."),
        ("/* Block\n * text */\nfunc F() {}", "Block\ntext "),
        ("//go:noinline\nfunc F() {}", None),
    ],
)
def test_docs(body, doc):
    assert go(body).defs[0]["doc"] == (doc.rstrip() if doc else None)


def test_group_doc_is_of_no_spec():
    got = go("// Group.\nconst (\n\tA = 1\n\t// Own.\n\tB = 2\n)").defs
    assert [d["doc"] for d in got] == [None, "Own."]


def test_broken_declaration_is_dropped_alone():
    got = go("func Good() { use(1) }\nfunc Bad( {{{\nfunc Fine() int { return 2 }\n")
    assert got.status == "partial"
    assert "Good" in [d["name"] for d in got.defs]
    assert "Bad" not in [d["name"] for d in got.defs]


def test_spans_are_bytes():
    src = "package p\n\nvar é = ü\n".encode()
    got = parse(src)
    assert src[got.defs[0]["start_byte"] : got.defs[0]["end_byte"]].decode() == "é = ü"
    assert src[got.refs[0]["start_byte"] : got.refs[0]["end_byte"]].decode() == "ü"


def test_container_of_a_reference():
    assert go("func F() { g() }\nvar x = h").refs[0]["container"] == "F"


def test_no_time_left():
    assert parse(b"package p\nfunc F() {}", 0).status == "timeout"


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=400))
def test_any_bytes(data):
    got = parse(data)
    assert got.status in ("ok", "partial")
    for kind in (got.defs, got.refs, got.imports):
        assert all(x["start_byte"] <= x["end_byte"] for x in kind)
        assert [x["start_byte"] for x in kind] == sorted(x["start_byte"] for x in kind)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["func ", "F", "(", ")", "{", "}", "type ", "T ", "struct", "[", "]", "int", "\n", ":=", "x", ".", ",", "if ", "for ", "range ", "var ", "= ", "1", '"s"', "// c\n"]), max_size=60))
def test_go_shaped_pieces(pieces):
    assert parse(("package p\n" + "".join(pieces)).encode()).status in ("ok", "partial")


def large(n):
    body = "// Doc {i}\nfunc (t *T) F{i}(a int, b string) (int, error) {{\n\tif a > {i} {{ return x.Foo(a, b), nil }}\n\tfor i := 0; i < a; i++ {{ t.y[i] = append(t.y[i], map[string]int{{\"a\": i}}) }}\n\treturn G{i}(a), nil\n}}\n"
    return ("package p\n\n" + "\n".join(body.format(i=i) for i in range(n))).encode()


def test_files_up_to_the_parsed_size_keep_their_facts():
    """Whatever the machine does at the time: the budget counts steps."""
    src = large(5200)[: (1 << 20) - 200]
    src = src[: src.rindex(b"\n}\n") + 3]
    got = parse(src)
    assert len(src) > 1_000_000 and got.status == "ok" and len(got.defs) == src.count(b"func (") and parse(src).refs == got.refs
    assert parse(b"package p\n" + b"var x = (1)\n" * 87_000).status == "ok"
    dense = parse(b"package p\nvar x = []int{" + b"1," * 520_000 + b"}\n")
    assert dense.status == "ok" and [d["name"] for d in dense.defs] == ["x"]


def test_deep_nesting_costs_its_declaration_alone():
    deep = "func Deep() { " + "if x { " * 300 + "y()" + " }" * 300 + " }\n"
    assert [d["name"] for d in parse(("package p\n" + deep + "func After() {}\n").encode()).defs] == ["Deep", "After"]
    deeper = "var v = " + "(" * 3000 + "1" + ")" * 3000 + "\n"
    got = parse(("package p\nfunc Before() {}\n" + deeper + "func After() {}\n").encode())
    assert got.status == "partial" and [d["name"] for d in got.defs] == ["Before", "After"]


def test_offsets_after_bytes_that_are_no_utf8():
    src = b"package p\n\n// caf\xe9 \xc3\xa9\nfunc A() { B(\"\xff\xfe\") }\n\nfunc B(s string) {}\n"
    got = parse(src)
    assert [src[d["start_byte"] : d["end_byte"]][:6] for d in got.defs] == [b"func A", b"func B"]
    assert got.defs[0]["doc"] == "caf� é" and [src[r["start_byte"] : r["end_byte"]] for r in got.refs] == [b"B"]
