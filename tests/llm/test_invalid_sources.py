"""Problem 2: grammars against known snippets and, for Python, against the language's own parser."""

import ast

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracegrove.llm.invalid_sources import check_files, invalid_rates, language_of, syntax_error
from tracegrove.llm.peg import Grammar

GOOD = {
    "python": ["", "# only\n", "x = [i for i in range(3) if i]\n", "def f(a, *, b: int = 1, **k) -> int:\n\treturn a if b else -b\n", "async def g():\n    async with a as b, c:\n        await d\n    return\n", "class A(B, metaclass=C):\n    '''d'''\n    x: int = 3\n\n    @property\n    def y(self): return self._y\n", "try:\n    pass\nexcept (A, B) as e:\n    raise X from e\nelse:\n    pass\nfinally:\n    del a[0], b\n", "f'{x}' \"(\"  # ) {\nprint(*a, **b, sep='')\nlambda *a, **k: (yield)\n", "match = 1\nmatch x:\n    case [1, *r] if r:\n        pass\n    case _:\n        pass\n", "\ufeffx = 1\r\nif x:\r\n  y = 2\r\n", "a = b = c, *d = e\nx += 1; y @= 2\nif (n := 3) > 2: pass\nwith (open(a) as b, c):\n    pass\n"],
    "javascript": ["'use strict'\nlet a = 1, {b, ...c} = d\nexport default class extends X { #p = 1; static async *m() { yield* a } get x() { return 1 } }", "for (const x of y) if (x) continue; else { break }\nlabel: while (1) { x++\n++y }", "const r = /[/(]{2}/g.test(s) ? a / b : `t ${x + `${y}`} (`;", "import a, * as b from './x.js'; import {c as d} from \"y\"; export * from 'z'; export {d as default};", "async () => { await x?.y?.[0]?.(z) ?? w; }; (a, b = 1) => a; x => ({y: 1, [z]: 2, get q() { return 1 }, async f() {}})", "!function(){var a=[1,,2];return a?b+1:void 0}();", "// only a comment", "switch (a) { case 1: case 2: f(); break; default: g() } do x--; while (x)\nthrow new Error('x')"],
    "typescript": ["import type { A } from './a';\nexport interface B<T extends A = A> extends C { readonly x?: string[]; [k: string]: any; m(a: number): void }\nexport type D = A | { a: 1 } & E[] | ((x: number) => void);\nexport enum F { A = 1, B }\n", "export function f<T>(this: X, a?: number, ...r: string[]): a is number { const x = <any>1 as unknown as T; return y!.z; }".replace("<any>1", "1"), "abstract class A<T> implements B, C { private readonly x: number = 1; constructor(public a: string, protected b?: T) { super(); } abstract m(): Promise<void>; static s?: A<B<C>>; }", "declare module 'x' { export const y: number; }\nlet z: typeof a.b = c satisfies D;"],
    "java": ["package a.b;\nimport java.util.*;\n@A(x = 1, y = {2, 3}) public final class C<T extends D & E> extends F<G<H>> implements I {\n static { x(); }\n private final int[] a = {1, 2}, b[] = null;\n public <U> U m(final U... u) throws X, Y { for (int i = 0, j = 1; i < 3; i++, j--) { if (a[i] >> 2 > 1) continue; } for (var x : xs) y(x); try (R r = new R()) { } catch (A | B e) { throw e; } finally { } return (U) (Object) u; }\n enum K { A(1) { void f() { } }, B; K() { } }\n Runnable r = () -> { }; Function<A, B> f = A::new, g = x -> x + 1;\n int s(int k) { return switch (k) { case 1, 2 -> 3; default -> { yield 4; } }; }\n}", "record P(int x, String y) { P { } }\n@interface Q { int v() default 1; }"],
    "go": ["package a\n\nimport (\n\t\"fmt\"\n\tx \"y/z\"\n)\n\ntype S[T any] struct {\n\tA, B int `json:\"a\"`\n\t*E\n}\n\nfunc (s *S[T]) M(a int, b ...string) (n int, err error) {\n\tfor i, v := range m {\n\t\tswitch x := v.(type) {\n\t\tcase int, string:\n\t\t\tcontinue\n\t\tdefault:\n\t\t}\n\t}\n\tif v, ok := m[k]; ok && v != (T{1}) {\n\t\tgo func() { ch <- 1 }()\n\t}\n\tselect {\n\tcase <-c:\n\t}\n\treturn len(a[1:2]), nil\n}\n"],
    "rust": ["#![allow(x)]\nuse a::{b, c::*};\npub(crate) struct S<'a, T: A + 'a>(&'a mut T) where T: B;\nimpl<'a, T> X for S<'a, T> {\n    type Y = Z;\n    fn m(&mut self, (a, b): (i32, &str)) -> Result<(), Box<dyn E>> {\n        let v: Vec<Vec<u8>> = vec![1u8, 2]; if let Some(x) = y.z()? { x as usize } else { 0..10 };\n        match q { A { b, .. } | C(1..=2) if b > 0 => { d() } _ => e!(\"{}\", f), }\n        for i in 0..n { s += i * 2; } 'l: loop { break 'l; }\n        let c = move |a: i32| -> i32 { a + 1 };\n        a[0].b.0 = !c;\n        Ok(())\n    }\n}\n"],
    "c": ["#include <a.h>\n#define X(a) \\\n  ((a) + 1)\ntypedef struct s { int a : 3; union { char b[4]; } *u; } s_t;\nstatic const unsigned char t[] = { 0x1, [2] = 3, };\nint (*fp)(int, char **) = 0;\nextern int f(void), g(int a, ...);\nint main(int argc, char *argv[])\n{\n    for (int i = 0; i < 3; ++i) { a->b[i] = (long) *p++ ? sizeof(int *) : -x; }\n    switch (x) { case 1: case 2: goto end; default: break; }\n    do { if (!x) return 0; else y = \"a\" \"b\"; } while (0);\nend:\n    return 0;\n}\n"],
    "csharp": ["using System;\nusing static A.B;\nnamespace N.M;\n[Attr(1)]\npublic sealed class A<T> : B, IC where T : class, new()\n{\n    private int? x = 1; public string P { get; private set; } = \"a\"; int Q => x ?? 2;\n    public event E H;\n    public A(int a) : base(a) { }\n    public async Task<int[]> M<U>(ref int a, out B b, params int[] c) { await foreach (var i in xs) { if (i is int k && k > 1) yield return k; } lock (o) { } using var z = new Z { A = 1 }; return y switch { 1 => 2, _ => throw new X() }; }\n    public static A<T> operator +(A<T> a, A<T> b) => a;\n    enum K { A = 1, B }\n}\n"],
    "ruby": ["x = f(<<~A, <<-'B')\n  it's (\n  A\nend {\n B\ny << z\n", "require 'a'\nmodule A\n  class B < C::D\n    attr_reader :x, :y\n    X = %w(a b)\n    def initialize(a, b = 1, *c, d: 2, &e)\n      @a = a if b\n      return 3 unless c.empty?\n      c.each do |i, (j, k)|\n        puts \"#{i}\" + 'x' if i =~ /a/\n      end\n      case a\n      when 1, 2 then 3\n      else 4\n      end\n      begin\n        f\n      rescue E => e\n        g\n      ensure\n        h\n      end\n      x = [1, 2].map { |v| v * 2 }.select(&:odd?)\n      while a < 3 do a += 1 end\n      h = { a: 1, 'b' => 2 }\n    end\n    def self.z; end\n  end\nend\n5.times do |i|\n  x ||= i\nend\n"],
    "sql": ["-- c\nCREATE TABLE IF NOT EXISTS a.b (id BIGSERIAL PRIMARY KEY, n VARCHAR(40) NOT NULL DEFAULT 'x', d DECIMAL(12, 2) CHECK (d > 0), t TIMESTAMP WITH TIME ZONE, FOREIGN KEY (n) REFERENCES c (n) ON DELETE SET NULL);\nINSERT INTO a (x, y) SELECT x, SUM(y) AS t FROM b LEFT JOIN c USING (x) WHERE x <> 'it''s' AND y IN (1, 2) GROUP BY x HAVING COUNT(*) > 1 ORDER BY 2 DESC LIMIT 3;\nWITH q AS (SELECT 1) UPDATE a SET x = CASE WHEN y IS NULL THEN 1 ELSE 2 END WHERE EXISTS (SELECT * FROM q);\nSELECT row_number() OVER (PARTITION BY a ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) r, x::int FROM t; DROP TABLE IF EXISTS t"],
}
BAD = {
    "python": ["def f(:\n    pass\n", "if x:\npass\n", "x = (1\n", "<<<<<<< HEAD\nx = 1\n=======\n", "  x = 1\n y = 2\n", "x = 'a\n", "x = 1\x00\n", "for i in range(3):\n", "a b\n", "return return\n", "func F() int {\n}\n", "f(a, b\nc\n"],
    "javascript": ["function f( {", "let a = ;", "class A { m() { }", "export function f(a: number): void {}", "const x = \"a;", "package a.b;", "a = 1\n<<<<<<< HEAD\nb", "if (a { }", "int f(int a)\n{\n}"],
    "typescript": ["class A {", "def f():\n    pass", "use a::b;", "let x: = 1;", "function f(a: number { }"],
    "java": ["class A { void m( { } }", "class A {", "package a\n", "class A { int x = 1 }", "def f(): pass", "import * as a from './a';"],
    "go": ["package a\nfunc f( {\n}\n", "func f() {}\n", "package a\nfunc f() {\n", "package a\nx = 1\n", "package a\n=======\n"],
    "rust": ["fn f( {}", "fn f() { let x = ; }", "fn f() { if x { }", "package a", "struct S { a: i32"],
    "c": ["int f(int a) {", "int x = ;", "package a;\nimport b.c;\n", "int f() { return 1 }", "int f() { \"a; }"],
    "csharp": ["class A {", "class A { int M( { } }", "import a\n", "class A { void M() { x = ; } }"],
    "ruby": ["x = <<~A\n  text\n", "def f\n  1\n", "class A\n  def f\n  end\n", "x = (1\n", "end\n", "package a;\nimport a.*;\n", "if a\n  b\nelse\n  c\nend\nend\n"],
    "sql": ["CREATE TABLE a (", "SELECT FROM", "INSERT INTO a (b VALUES (1);", "CREATE TABLE a (x INT,\n<<<<<<< HEAD\ny INT);", "SELECT a FROM b WHERE;", "class A { }"],
}


@pytest.mark.parametrize("language", GOOD)
def test_valid(language):
    for text in GOOD[language]:
        assert syntax_error(language, text) is None, (text, syntax_error(language, text))


@pytest.mark.parametrize("language", BAD)
def test_invalid(language):
    for text in BAD[language]:
        assert syntax_error(language, text) is not None, text


def test_furthest_failure():
    assert syntax_error("python", "x = 1\ny = (2,\n  3 4)\n")[:2] == (3, 5)
    assert syntax_error("java", "class A {\n  int x = 1\n}\n")[0] == 3
    assert syntax_error("c", "int f() {\n<<<<<<< HEAD\n  return 1;\n}\n")[3] == "conflict"
    assert syntax_error("go", "package a\nfunc f() {\n")[3] == "truncated"


def test_packrat_matches_plain_grammar():
    g = Grammar("start <- sum EOF\nsum <- atom (('+' / '-') atom)*\natom <- NUM / '(' sum ')'\n")
    ok = lambda *k: g.parse([*k, "EOF"], [0] * (len(k) + 1))
    assert ok("NUM", "+", "(", "NUM", ")") == -1
    assert ok("NUM", "+") == 2
    assert ok(*["("] * 2000, "NUM", *[")"] * 2000) == -1


PARTS = st.sampled_from(["x", " ", "\n", "    ", "(", ")", ":", "if ", "def f", "1", "+", "=", "'a'", ",", "[", "]", "return ", "in ", "for ", ".", "pass", "else"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_python_agrees_with_its_parser_on_rejected_text(text):
    """What the grammar rejects, Python rejects as well (the grammar leaves out a few checks that are no grammar)."""
    if syntax_error("python", text) is not None:
        with pytest.raises(SyntaxError):
            ast.parse(text)


def test_operator(spark):
    rows = [("r/a.py", 1.0, "x = ("), ("r/a.py", 2.0, "x = 1"), ("r/b.PY", 0.0, "x = ("), ("r/b.PY", 0.0, "x = ("), ("r/c.md", 1.0, "("), ("r/d.go", 1.0, None), ("r/e.js", None, ""), ("r/f.c", 1.0, "// only"), ("r/g", 1.0, "("), (None, 1.0, "(")]
    df = spark.createDataFrame(rows, "relative_path string, mtime double, content string").selectExpr("*", "1 as language", "2 as invalid", "3 as cause")
    assert [r.relative_path for r in check_files(df).where("invalid").collect()] == ["r/b.PY"]
    rates = {r.language: (r.files, r.invalid_files) for r in invalid_rates(df).collect()}
    assert rates == {"python": (2, 1), "go": (1, 0), "javascript": (1, 0), "c": (1, 0)}
    assert check_files(df.limit(0)).count() == 0
    assert language_of("x/Y.MJS") == "javascript" and language_of(None) is None
