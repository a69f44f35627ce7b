"""Problem 3."""

import pytest

from tracegrove.llm import islands as I


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ("Not thread safe.", True), ("Counts bytes, not rows.", True), ("Gibt die Anzahl der offenen Belege zurück.", True), ("Merge the open queue.", False), ("mergeOpenQueue", False), ("This method merges the open queues.", False),
        ("TODO: write docs", False), ("n/a", False), ("No description.", False), ("@param size\n@return", False), ("@param size upper bound, in rows", True), ("Args:\n    size:\nReturns:\n    int", False), ("Args:\n    size: upper bound, in rows", True),
        ("@since 2.1\n@author me", False), ("----------\nqueue\n----------", False), ("i = i + 1\nreturn i", False), ("{@inheritDoc}", False), ("/** */", False), ("// eslint-disable-next-line", False), ("Copyright the authors. All rights reserved.", False),
        ("TODO: speed this up. Never returns zero.", True), ("", False), (None, False), ("@return the number of rows touched", True), ("(int, int) -> int", False), ("queue queue queue", False), ("#region", False),
    ],
)
def test_said(doc, want):
    assert I.said("merge_open_queue", "def merge_open_queue(size: int)", doc) is want


@pytest.mark.parametrize(
    ("doc", "want"),
    [
        ("idempotent", True), ("memoized", True), ("идемпотентна", True), ("合并所有未结队列", True), ("待ち行列を結合する", True), ("costs about 3 ms", True), ("logged under `queue`", True), ("introduced together with the audit trail", True),
        ("queue", False), ("queues", False), ("batch batch batch", False), ("~~~~~~\ntariff\n~~~~~~", False), ("int", False), ("undocumented", False), ("tbd", False), ("description", False),
    ],
)
def test_short_documentation_in_any_language(doc, want):
    assert I.said("merge_open_queue", "def merge_open_queue(size: int)", doc) is want


def test_scripts_without_spaces_are_compared_by_character():
    assert not I.said("合并队列", None, "队列合并") and I.said("合并队列", None, "合并空队列")


def test_docs_by_line():
    java = "class A {\n    /** Tells. */\n    // more\n    int f() { String s = \"// no\"; }\n\n    // far\n\n    int g() { }\n    int h() { } // behind\n    int i() { }\n}\n"
    docs = I.docs_by_line("java", java)
    assert docs[4] == "// more" and 8 not in docs and 10 not in docs
    python = "@dec(1)\ndef f(a=')', b: int = 2) -> x:\n    # c\n    '''Doc \" x.'''\n    return 1\n\nclass B:\n    def g(self): 'one'\n    def h(self):\n        return 'no'\n"
    docs = I.docs_by_line("python", python)
    assert docs[1] == docs[2] == 'Doc " x.' and docs[8] == "one" and 9 not in docs
    assert I.line_count("a\nb") == I.line_count("a\nb\n") == 2 and I.line_count("") == 0


NODES = "node_seq long, id string, name string, node_type string, class_name string, signature string, docstring string, file_path string, line_start int, line_end int, removed_at timestamp"


def node(seq, i, doc, path="r/a.js", a=2, b=2, kind="function", gone=None):
    return (seq, i, "f", kind, None, None, doc, path, a, b, gone)


def test_operator(spark):
    from datetime import datetime

    t = datetime(2025, 1, 1)
    rows = [
        node(1, "kept", "Counts bytes."), node(1, "file", None), node(1, "trivial", "f"), node(1, "gone", "Counts bytes."), node(2, "gone", "Counts bytes.", gone=t), node(1, "back", "Counts bytes.", gone=t), node(2, "back", "Counts bytes."),
        node(1, "out", "Counts bytes.", b=3), node(1, "null", "Counts bytes.", a=None), node(1, "class", "Counts bytes.", kind="class"), node(1, "nofile", "Counts bytes.", path="r/b.js"), node(1, "crlf", None, path="r/c.py", a=1, b=3), node(1, None, "Counts bytes."), node(1, "empty", "", a=1),
    ]
    files = spark.createDataFrame([("r/a.js", 2.0, "// Never zero.\nfunction f() {}"), ("r/a.js", 1.0, "\n\n\n\n"), ("r/c.py", 0.0, "def f():\r\n  '''Never\r\n  zero.'''"), ("r/d.js", 1.0, None)], "relative_path string, mtime double, content string")
    nodes = spark.createDataFrame(rows, NODES)
    assert sorted(r.id for r in I.documented(nodes, files).collect()) == ["back", "crlf", "file", "kept"]
    code = {r.id: r.code for r in I.pairs(nodes, files).collect()}
    assert code["kept"] == "function f() {}" and code["crlf"] == "def f():\n  '''Never\n  zero.'''"
    assert I.documented(nodes.limit(0), files).count() == 0 and I.documented(nodes, files.limit(0)).count() == 0


FORMS = {
    "java": ('class A {\n  /** Doc one. */\n  @Override\n  @Deprecated(since = "1")\n  public <T> List<Map<String, T>> f(int a,\n      String b) throws X {\n    String s = "} // {";\n    if (a) { g(); }\n  }\n  // plain\n  abstract int h();\n  int x = f(1);\n}\n', [("f", 3, 5, 9, "/** Doc one. */"), ("h", 11, 11, 11, "// plain")]),
    "csharp": ('class A {\n  /// <summary>Doc.</summary>\n  [Test, Case(1)]\n  public async Task<int> F(int a) {\n    var s = @"a ""}"" // {";\n    return 1;\n  }\n  // two\n  int G() => 3;\n}\n', [("F", 3, 4, 7, "/// <summary>Doc.</summary>"), ("G", 9, 9, 9, "// two")]),
    "rust": ("/* a /* nested */ doc */\n#[inline]\n#[cfg(any(a,\n  b))]\npub(crate) async fn f<T>(x: &str) -> u8 {\n  let c = '{'; let s = r#\"}\"#;\n}\n/// d\nfn g();\n", [("f", 2, 5, 7, "/* a /* nested */ doc */"), ("g", 9, 9, 9, "/// d")]),
    "go": ("// Doc of F.\nfunc (s *S) F(a int) (b int) {\n\tx := `}`\n}\n", [("F", 2, 2, 4, "// Doc of F.")]),
    "ruby": ("=begin\nDoc here.\n=end\ndef f(a)\n  if a\n    b\n  end\n  c.each do |x|\n    y\n  end\nend\n# two\ndef g = 1\nclass A\n  # three\n  def self.h?; end\nend\n", [("f", 4, 4, 11, "=begin\nDoc here.\n=end"), ("g", 13, 13, 13, "# two"), ("h?", 16, 16, 16, "# three")]),
    "c": ('/* Doc. */\nstatic int\nf(int a)\n{\n  char *s = "}";\n  return a;\n}\n// p\nint g(int);\n', [("f", 2, 2, 7, "/* Doc. */"), ("g", 9, 9, 9, "// p")]),
    "javascript": ("/** D. */\nexport async function f(a, {b}) {\n  const s = `}${a}`;\n}\n// arrow\nconst g = (x) => {\n  return { a: 1 };\n};\nclass A {\n  // m\n  static async *m(a, b = f(1)) { if (a) { } }\n  /** no call */\n  run(x);\n}\n", [("f", 2, 2, 4, "/** D. */"), ("g", 6, 6, 8, "// arrow"), ("m", 11, 11, 11, "// m")]),
    "typescript": ("/** D. */\n@Dec({\n  a: 1,\n})\nexport function f<T>(a: T): Map<string, T> {\n}\nclass A {\n  // m\n  private m(a: string): { x: number } {\n  }\n}\n", [("f", 2, 5, 6, "/** D. */"), ("m", 9, 9, 10, "// m")]),
    "python": ('@a(1,\n   b=2)\n@c\ndef f(a, b=")"):\n    """Doc\nat margin.\n    """\n    if a:\n        x = [1,\n2]\n    return """\nz"""\n\nclass A:\n    # above\n    async def g(self): "one"\n    def h(self):\n        pass\n# end\nx = 1\n', [("f", 1, 4, 12, "Doc\nat margin.\n    "), ("g", 16, 16, 16, "one"), ("h", 17, 17, 18, None)]),
    "sql": ("-- Doc.\nCREATE OR REPLACE FUNCTION f(a int) RETURNS int AS $$\n  SELECT 1; -- x\n$$ LANGUAGE sql;\n", [("f", 2, 2, 4, "-- Doc.")]),
}


@pytest.mark.parametrize("language", FORMS)
def test_island_grammar(language):
    text, want = FORMS[language]
    found, _ = I.read(language, text)
    assert [(d.name, d.top, d.line, d.end, d.doc) for d in found] == want
    lines = text.split("\n")
    for d in found:
        assert I.code_by_line(language, text)[d.top] == {"last": d.end, "text": "\n".join(lines[d.top - 1 : d.end])}
        assert d.doc is None or I.docs_by_line(language, text)[d.line] == d.doc


def test_water_without_end_is_no_trap():
    for language in I.GRAMMARS:
        for text in ("", "/*", '"""', "'", "`", "$$", "=begin\n", "@", "#[", "[A", "def f(", "((((", "}}}}\n"):
            I.read(language, text), I.docs_by_line(language, text), I.code_by_line(language, text)


def test_given_lines_that_are_no_declaration(spark):
    """Documentation is what stands above; the code is cut by the given lines."""
    files = spark.createDataFrame([("r/a.js", 1.0, "// Never zero.\nx = 1;\ny = 2;\n// Counts rows.\nfunction f() {\n}\n")], "relative_path string, mtime double, content string")
    nodes = spark.createDataFrame([node(1, "odd", None, a=2, b=3), node(2, "whole", None, a=5, b=6), node(3, "part", None, a=5, b=5)], NODES)
    got = {r.id: (r.documentation, r.code) for r in I.pairs(nodes, files).collect()}
    assert got == {"odd": ("// Never zero.", "x = 1;\ny = 2;"), "whole": ("// Counts rows.", "function f() {\n}"), "part": ("// Counts rows.", "function f() {")}


@pytest.mark.parametrize("doc", ["Version: returns the schema revision.", "Go: blocks until drained.", "Introduced together with the retry queue and requires it to be running.", "Type: picks the smaller one."])
def test_labels_hide_nothing(doc):
    assert I.said("merge_open_queue", None, doc)


@pytest.mark.parametrize("doc", ["go:generate x", "type: ignore", "pragma: no cover", "version: 1.2.3", "since: v2", "date: 2025-01-02"])
def test_pragmas_say_nothing(doc):
    assert not I.said("merge_open_queue", None, doc)
