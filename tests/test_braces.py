"""Symbols of C, C++, JavaScript and TypeScript, against spans written out by hand."""

import pytest
from pyspark.sql import SparkSession

from quarry.operators import chunking
from quarry.operators.braces import brace_symbols, masked

C = """#include <a.h>
#define LOOP(x) for (;;) { \\
  x
/* int no(void) { */
static const int table[] = { 1, 2 };
struct point { int x, y; };
enum kind { A, B };

int add(int a, int b)
{
    if (a) { return '}'; }
    return a + b; // }
}
struct point *make(void) { char *s = "}{"; return 0; }
int declared(int);
"""
CPP = """namespace n {
class A : public B {
public:
    A() : x{1}, y(2) { go(); }
    ~A() {}
    int é() const noexcept { return x; }
    bool operator==(const A& o) const { return true; }
    A(const A&) = default;
    auto f() -> int { return R"(})"[0]; }
};
template <typename T, class U>
T g(T t) { auto h = [](int i) { return i; }; return t; }
}
extern "C" { void k() {} }
int v = sum(1);
auto w = [](int i) { return i; };
"""
JS = """function top() { if (a) { b(); } }
class K extends mixin(Base) {
  constructor(x) { super(x); }
  static async go(a, b = { c: 1 }) {
    for (const q of a) { q(); }
  }
  get v() { return /[/}]{/.test(`${1}}`); }
  *[Symbol.iterator]() { yield 1; }
  #hidden() { return "}"; }
  field = () => { return 1; };
}
const o = { m() { return function () {}; }, n: function () {} };
foo(function named() {}, (x) => { y(); });
"""
TS = """abstract class T<A> {
  private async load<X>(x: X): Promise<{ a: X }> { return { a: x }; }
  over(a: string): void;
  shape(): { a: number } | null { return null; }
  abstract none(): void;
  cond(a) { switch (a) { case f(): { break; } } return a ? g() : { b: 1 }; }
}
interface I { m(): void }
function plain(a: number): number { return a; }
"""


def heads(source, language):
    return [x[0].split("{")[0].strip() for x in brace_symbols(source, language)]


@pytest.mark.parametrize(
    ("language", "source", "want"),
    [
        ("c", C, ["int add(int a, int b)", "struct point *make(void)"]),
        ("cpp", CPP, ["A() : x", "~A()", "int é() const noexcept", "bool operator==(const A& o) const", "auto f() -> int", "T g(T t)", "void k()"]),
        ("javascript", JS, ["constructor(x)", "static async go(a, b =", "get v()", "*[Symbol.iterator]()", "#hidden()", "m()"]),
        ("typescript", TS, ["private async load<X>(x: X): Promise<", "shape():", "cond(a)"]),
        ("java", "class A { void f() {} }", []),
        ("c", "int broken( {", []),
        ("c", "", []),
    ],
)
def test_heads(language, source, want):
    assert heads(source, language) == want
    raw = source.encode()
    for text, kind, _, first, last, lo, hi in brace_symbols(source, language):
        assert raw[lo:hi].decode() == text and text.endswith("}") and kind == "function"
        assert first == raw[:lo].count(b"\n") + 1 and last == first + text.count("\n")


def test_masks_keep_length():
    for kind, source in (("c", C), ("c", CPP), ("js", JS), ("js", TS)):
        code = masked(source, kind)
        assert len(code) == len(source) and [i for i, c in enumerate(code) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]


def test_chunks_of_braces(spark: SparkSession):
    rows = [("p", "a.c", C), ("p", "b.ts", TS), ("p", "c.js", "function a() {}"), ("p", "d.java", "class A { void f() {} }")]
    got = chunking.chunks(spark.createDataFrame(rows, "project string, path string, text string")).collect()
    kinds = {path: sorted((r["type"], r["line_start"], r["line_end"]) for r in got if r["path"] == path) for path in ("a.c", "b.ts", "c.js", "d.java")}
    assert kinds == {"a.c": [("function", 9, 13), ("function", 14, 14)], "b.ts": [("function", 2, 2), ("function", 4, 4), ("function", 6, 6)], "c.js": [("block", 1, 1)], "d.java": [("block", 1, 1)]}


def test_runs_of_modifiers_take_linear_time():
    import time

    for body in ("static " * 60_000, "a<" * 30_000, "get set " * 30_000 + "x", "[" * 1 + "a " * 60_000 + "]"):
        began = time.time()
        brace_symbols("class A {\n" + body + "\nstatic async f() { }\n}\n", "javascript")
        assert time.time() - began < 5, body[:20]
    assert [x[0] for x in brace_symbols("class A { static async f() { } get (x) { } *gen() { } static get y() { } }", "javascript")] == ["static async f() { }", "get (x) { }", "*gen() { }", "static get y() { }"]


def test_first_branch_and_old_heads():
    source = "#ifdef A\nint f(int x) {\n#else\nint f(long x) {\n#endif\n  return x;\n}\nint g(a, b) int a; char *b, c[2]; { return a; }\nint h(int);\nint k(void) { return 1; }\nMACRO(z) int q; int m() { return 2; }\n"
    got = [x[0].split("{")[0].strip().split("(")[0].split()[-1] for x in brace_symbols(source, "c")]
    assert got == ["f", "g", "k", "m"]
