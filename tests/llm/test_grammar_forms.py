"""Problem 2: forms of each language that must pass, and errors that must not."""

import ast
import random

import pytest

from tracegrove.llm.invalid_sources import syntax_error

GOOD = {
    "typescript": ["type M<T> = { readonly [K in keyof T]: T[K] }", 'let x: typeof import("./a");', "type A = { [K in X as `a${K}`]?: T }", "let x = y as const;", "function f(x: unknown): asserts x is string {}", "const a = <T,>(x: T) => x;", "export default interface X {}", "abstract class A { abstract get x(): number; }", "let a = b!;", "type F = new (...args: any[]) => object;", "declare global { interface W { x: 1 } }", 'import x = require("y");', "for (const [a, b] of c) {}", "type X = A extends infer U ? U : never;", "let t: [a: string, b?: number, ...c: X[]];", "@dec() class A { @p() x = 1; constructor(@I() private a: B) {} }", "function f(): void;\nfunction f(a?: number): void {}", "let x = a?.b!.c;", "type U = `a${string}`;", "class A { declare x: number; static { } }", "let v = f<number>(1);", "x satisfies Y;", "type G = typeof x[number];", 'export type { A } from "./b";', "let n: unique symbol;", "declare const x: number;", "declare namespace N { const y: string; }", "x! = 1; (y as any).z = 2;", "const enum E { A }"],
    "rust": ["fn f() { match n { n @ 1..=9 => 1, _ => 2 }; }", "/* a /* b */ c */ fn f() {}", "fn f() -> impl Fn(i32) -> i32 + 'static { |x| x }", "fn f() { let Some(x) = y else { return }; }", "fn f<const N: usize>() {}", "async fn f() { a.await?; }", "fn f() { let x = if a { 1 } else { 2 } + 3; }", "pub(crate) use a::b as c;", "macro_rules! m { ($x:expr) => { $x }; }", "fn f() { let x = &mut *y; let r = ..=5; }", "impl<T> A for B<T> where T: C<D = E> {}", "fn f(x: &dyn Fn() -> u8) {}", "fn f() { x.0.1; 1.0f32; 0xffu8; }", "fn f() { let c = b'a'; let s = br#\"x\"#; }", "fn f() { 'a: for x in y { continue 'a } }", 'unsafe extern "C" fn f() {}', "fn f() { let _ = S { x, ..Default::default() }; }", "fn f() { matches!(x, A | B if c) }", "#[derive(A)] enum E { A = 1, B(u8), C { x: u8 } }", "trait T { type X: A; const C: u8 = 1; fn f(&self); }", "fn f() { let y = x as u8 < 3; }"],
    "c": ["int x = _Generic(y, int: 1, default: 2);", '_Static_assert(sizeof(int) == 4, "x");', "int f(void) { return (struct s){ .a = 1 }.a; }", "void (*signal(int, void (*)(int)))(int);", "int a[] = { [0 ... 3] = 1 };", "_Bool b; _Noreturn void f(void);", "int main(void) { goto x; x: return 0; }", "int f(a, b) int a; char b; { return a; }", "__attribute__((unused)) static int x;", 'int f() { asm volatile ("nop"); }', "_Alignas(16) int x;", "int f() { for (;;) ; }", "double _Complex z;", "_Atomic int x; _Thread_local int y;"],
    "csharp": ["class A { public required int X { get; init; } }", "class A { void M() { if (x is [1, .., 2]) { } } }", 'class A { string s = $"{d["k"]}"; }', 'class A { string s = $"""\n {x}\n """; }', "record P(int X, int Y);", "var x = 1; System.Console.WriteLine(x);", "class A { void M() { var (a, b) = (1, 2); } }", "class A { void M() { (a, b) = (b, a); } }", "class A { void M() { foreach (var (k, v) in d) { } } }", "class A { int? x; int[]? y; string z = null!; }", "class A { void M() { x ??= 1; y?.Z(); var q = a[^1]; var r = a[1..2]; } }", "class A { void M() { var x = y switch { 1 or 2 => 3, > 4 and < 5 => 6, { P: 1 } => 7, null => 8, _ => 9 }; } }", "global using System;", "class A { static async Task<int> M() { await using var x = y; return await z; } }", "class A { public static explicit operator int(A a) => 1; }", "class A { void M() { var q = from x in xs where x > 1 orderby x descending select new { x }; } }", "class A(int x) : B(x) { }", "class A { void M() { try { } catch (E e) when (e.X) { } } }", "class A { int[] x = [1, 2, ..y]; }", "class A { void M() { M2(x: 1, out var y, ref z); } }", 'class A { string s = @"a""b"; string t = $@"{x}""y {z:N2} {w,5}"; }', "class A { void M() { if (o is string { Length: > 1 } s && s is not null) { } a.b().c++; await d; new E(); } }"],
    "ruby": ["case x\nin {a: Integer => b}\n  1\nin [Integer => a, *]\n  2\nend", "x = y rescue z", "def f(a, b: 1, **o, &blk) = a", "a, (b, *c), d = 1, [2, 3], 4", "x = if a then b else c end", "foo do |a, b = 1; c| end", 'h = {a: 1, "b": 2, :c => 3}', "class << self; end", "def self.x = 1", "-> (x) { x }", "x&.y ||= 1", "begin; a; end while b", 'puts "a#{x["k"]}b"', "x = [1,\n 2,\n]", "def x?; end", "obj.foo = 1", "5.times { |i| p i }", "x = %i[a b]", "/a#{b}/i =~ c", "def f(...) = g(...)", "p(*a, **b)", "if x\nelsif y\nelse\nend", "while x do y end", "until x; y; end", "for a in b do c end", "a = ?x", "def y=(v)\n  @y = v\nend", "loop do\n  x while y\nend"],
    "sql": ["MERGE INTO a USING b ON a.x = b.x WHEN MATCHED THEN UPDATE SET y = 1 WHEN NOT MATCHED THEN INSERT (x) VALUES (1);", "CREATE FUNCTION f(a INT) RETURNS INT AS $$ BEGIN RETURN 1; END $$ LANGUAGE plpgsql;", "CREATE PROCEDURE p() BEGIN SELECT 1; END;", "CREATE TRIGGER t BEFORE INSERT ON a FOR EACH ROW EXECUTE FUNCTION f();", "SELECT a FROM b GROUP BY GROUPING SETS ((a), ());", "CREATE TABLE a (x INT) PARTITION BY RANGE (x);", "SELECT $tag$a;b$tag$;", "SELECT * FROM a FOR UPDATE;", "SELECT * FROM a TABLESAMPLE BERNOULLI (10);", "SELECT a FROM b GROUP BY ROLLUP (a), CUBE (b);", "CREATE SEQUENCE s START WITH 1;", "SELECT ARRAY[1,2], x[1], INTERVAL '1 day', DATE '2020-01-01';", "SELECT EXTRACT(YEAR FROM x), CAST(x AS DECIMAL(1,2)), x::text FROM y;", "SELECT a FROM b CROSS JOIN LATERAL (SELECT 1) c;", "INSERT INTO a VALUES (1) ON CONFLICT (x) DO UPDATE SET y = EXCLUDED.y;", "EXPLAIN SELECT 1;", "SET search_path = x;", "GRANT SELECT ON a TO b;", "COMMENT ON TABLE a IS 'x';", "SELECT TOP 10 * FROM a;", "SELECT a, COUNT(*) FILTER (WHERE b) FROM c;", "SELECT x FROM a WHERE b LIKE '%' ESCAPE '\\' AND c ~* 'd';", "VACUUM ANALYZE a;", "USE db;", "DECLARE @x INT = 1;", "SELECT a FROM b FETCH FIRST 5 ROWS ONLY;", "CREATE TYPE e AS ENUM ('a');", "SELECT [a b] FROM [c];", "CALL p(1);", "PRAGMA foreign_keys = ON;", "SELECT a FROM b WINDOW w AS (PARTITION BY c);", "SELECT window, fetch, merge FROM t;", "CREATE TABLE window (merge INT, fetch TEXT);", "SELECT substring(a FROM 1 FOR 2) FROM b;"],
    "python": ['f"{d["k"]}"\n', 'f"{x!r:>{w}}"\n', "match x:\n    case A(b=1) | [c, *_] if d:\n        pass\n", "type X[T] = list[T]\n", "async def f():\n    return [x async for x in y]\n", "try:\n    pass\nexcept* E:\n    pass\n", "with (a as b):\n    pass\n", 'print(f"{a}{b}" "c")\n', "lambda: (yield)\n", "def f(a, /, b, *, c): pass\n", "def f(a, b=1, /, c=2, *d, e, f=3, **g): pass\n", "@a.b[1]\ndef f(): pass\n", "x = *a, b\n", "del (a), b[0]\n", "for x in *a, b: pass\n", 'f"{x:{y}}"\n', "f'{x=}'\n", 'f"""{\nx}"""\n', "f(*a, b, c=1, *d, **e)\n", "a.b[c].d: int = 1\n", "(a) = b.c = [d, *e] = f\n", "x = {**a, 'b': 1}; y = {*a, b}; z = [*a]\n", "f'{a:%Y-%m}' f'{{}}'\n", "0o17, 0xFF_FF, 1_000.5e3j\n"],
    "javascript": ["`${xs.map(x => { return {a:x}; })}`", "`${f({a:{b:1}})}`", "class A { #x; static #y() {} get z() {} static { } }", "for await (const x of y) {}", "const {a = 1, ...b} = c;", "async function* f() { yield* g(); }", "x ??= y; a ** b;", "new.target; import.meta.url;", "tag`a${b}c`", "`a${`b${c}`}`", "if (x) /re/.exec(y)", "x = a ? /b/ : /c/", "a = b / c / d; (e) / f", "const a = {b() {}, async c() {}, *d() {}, [e]: 1, 'f': 2}", "for (const k in o) ; for (let i = 0, j; i < 3; i++) {}", "({a, b: [c]} = d); [e, f.g] = h; i[0].j = k().l += 1;"],
    "java": ["class A { int x = switch (y) { case 1 -> 2; default -> { yield 3; } }; }", "sealed interface S permits A, B {}", "class A { void f() { if (o instanceof String s && s.isEmpty()) {} } }", 'class A { String s = """\n  a "b" \\""" c\n  """; }', "class A<T extends B & C> { <U> void f(U... u) throws E {} }", "class A { void f() { Runnable r = () -> {}; F g = A::new; H h = int[]::new; } }", "class A { void f() { switch (x) { case A a when a.b() -> {} case P(int x, var y) -> {} case null, default -> {} } } }", "module a.b { requires c; exports d; }", "class A { void f() { a = b = c; x >>>= 1; y = a > b ? c : d; } }", "void main() { }", "class A { Outer.Inner<B> x = o.new Inner<>(); }", "class A { void f() { new B() { void g() {} }.g(); this.x[1].y = 2; a.<B>c(); i++; --j; for (;;) {} } }"],
    "go": ["package a\nfunc f[T any, U ~int | string](x T) (y U) { return }", "package a\nfunc f() { for range 10 {} ; for i := range n {} }", "package a\nfunc f() { defer func() { recover() }() }", "package a\nfunc f() { select { case x, ok := <-c: default: } }", "package a\nfunc f() { a, b = b, a; x <<= 1; c <- v; *p = 1; m[k].x = 2 }", "package a\nfunc f() { go a.b(c)(d) }", "package a\nfunc f() { if x := (T{1}); x.y {} }"],
}
BAD = {
    "python": ["f() = 1\n", "1 = x\n", 'f"{a"\n', 'x = f"{]}"\n', "a + b = c\n", "def f(a=1, b): pass\n", "f(a=1, 2)\n", "{a: 1, b}\n", "[*a for a in b]\n", "else: pass\n", "lambda x=1, y: 0\n", "for 1 in x: pass\n", "with a as 1: pass\n", "del f()\n", "(a, b): int = 1\n", "f(**a, *b)\n", "f(x for x in y, 1)\n", "x = 0777\n", "1__0\n", "None = 1\n", "*a = 1\n", "x = *a\n", "if x = 1: pass\n", 'f"{a!}"\n', "f'{a b}'\n"],
    "javascript": ["const x;", "1 = x;", "a++ = 2;", "`${ ] + }`", "for (const x = 1 of y) {}", "const {a};", "let [a];", "f() = 1", "(a, b) = 1", "`${a", "() + ", "a => { "],
    "typescript": ["const x: number;", "`${ ] }`", "type X = ;", "interface A { x: }"],
    "java": ["class A { void f() { 1 + 2; } }", "class A { void f() { x; } }", "class A { void f() { 1 = x; } }", "class A { void f() { x() = 1; } }", "class A { void f() { a b c; } }"],
    "go": ["package a\nfunc f() { 1 + 2 = x }", "package a\nfunc f() { go x }", "package a\nfunc f() { if x = 1 }"],
    "csharp": ["class A { void M() { 1 + 2; } }", "class A { void M() { x y z; } }", 'class A { void M() { x = $"{y"; } }', "class A { void M() { f() = 1; } }"],
    "rust": ["/* a /* b */ fn f() {}", "fn f() { let = 1; }"],
    "ruby": ["1 = x", '"#{a"', '"#{]}"', "while x do y"],
    "sql": ["SELECT FROM a", "MERGE INTO a USING b;", "CREATE PROCEDURE p() BEGIN SELECT (1; END;", "use a::b;", "SELECT a FROM b GROUP a"],
}


@pytest.mark.parametrize("language", GOOD)
def test_forms_that_pass(language):
    wrong = [(t, e) for t in GOOD[language] if (e := syntax_error(language, t)) is not None]
    assert not wrong


@pytest.mark.parametrize("language", BAD)
def test_errors_that_do_not(language):
    assert not [t for t in BAD[language] if syntax_error(language, t) is None]


def test_deep_nesting_gives_a_verdict():
    for language, text in (("python", "x = {}\n"), ("javascript", "x = {};"), ("c", "int x = {};")):
        for depth in (150, 100_000):
            got = syntax_error(language, text.format("(" * depth + "1" + ")" * depth))
            assert got is None if depth == 150 or language != "python" else got[3] == "too_deep"
    assert syntax_error("javascript", "x = " + "(" * 100_000 + "1" + ")" * 99_999 + ";") is not None
    assert syntax_error("javascript", "[" * 1_500_000)[3] in ("too_deep", "truncated")


def _parts(text):
    import io
    import tokenize

    return [t.string for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.string.strip()]


SOURCES = [t for t in GOOD["python"] if len(t) > 12] + [
    "def f(a, b=1, *c, d=2, **e):\n    x = [i for i in range(3) if i]\n    return {1: 2, **x}\n",
    "class A(B, m=C):\n    x: int = 3\n    def g(self):\n        with a as b, c:\n            yield from d\n        for i, j in k:\n            del i[0], j.x\n",
    "try:\n    a, *b = c\nexcept (X, Y) as e:\n    raise Z from e\nelse:\n    print(*a, sep='')\nfinally:\n    x += 1\n",
]


@pytest.mark.parametrize("seed", range(3))
def test_mutated_python_is_judged_as_its_parser_does(seed):
    """Cut, a token dropped, two tokens swapped: both ways the same verdict."""
    import warnings

    rd, differ, n = random.Random(seed), [], 0
    for text in SOURCES * 8:
        parts = _parts(text)
        i, j = rd.randrange(len(parts)), rd.randrange(len(parts))
        kind = rd.choice("cds")
        if kind == "c":
            new = text[: rd.randrange(len(text))]
        elif kind == "d":
            new = text.replace(parts[i], "", 1)
        else:
            new = text.replace(parts[i], "\0", 1).replace(parts[j], parts[i], 1).replace("\0", parts[j], 1)
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            try:
                ast.parse(new)
                fine = True
            except SyntaxError:
                fine = False
        n += 1
        if (syntax_error("python", new) is None) != fine:
            differ.append((fine, new))
    assert len(differ) <= 0.02 * n, differ
