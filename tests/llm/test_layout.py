"""Problem 4."""

import random

import pytest

from tracegrove.llm import layout as L

FILE_SCHEMA = "relative_path string, mtime double, content string"
HAND = "import a\n\n" + "\n".join(f"def f{i}(x):\n    y = x + {i}\n    return g(y, 'a b')\n" for i in range(12))


@pytest.mark.parametrize(
    ("path", "text", "want"),
    [
        ("r/a.py", HAND, None), ("r/a.py", "# Code generated by x. DO NOT EDIT.\n" + HAND, "generated"), ("r/a.py", 'BANNER = "# Code generated by x. DO NOT EDIT."\n' + HAND, None),
        ("r/a.py", "# This module is written by hand; the generated stubs live in ../stubs.\n" + HAND, None), ("r/vendor/x/a.py", HAND, "vendored"), ("r/vendors/a.py", HAND, None),
        ("r/a.py", "# This file is part of thing.\n" + HAND, "vendored"), ("thing/a.py", "# This file is part of thing.\n" + HAND, None), ("r/a_pb2.py", HAND, "generated"), ("r/generators/a.py", HAND, None),
        ("r/a.js", "var a=function(e){return e+1};" * 200, "minified"), ("r/a.py", "DATA = [\n" + "    1234, 5678, 9012, 3456,\n" * 200 + "]\n", "data"),
        ("r/a.py", "# " + "word " * 800 + "\n" + HAND, None), ("r/a.py", 'HINT = "' + "some words here " * 200 + '"\n' + HAND, None), ("r/a.sql", "".join(f"INSERT INTO t (a, b, c) VALUES ({i}, {i}.5, 'late');\n" for i in range(40)), "data"),
        ("r/a.sql", "".join(f"CREATE TABLE t{i} (\n    a INT,\n    b DECIMAL(12, {i})\n);\n" for i in range(20)), None), ("r/a.md", "DO NOT EDIT", None), ("r/a.py", None, None), ("r/a.py", "", None),
    ],
)
def test_reason(path, text, want):
    assert L.reason(path, text) == want


@pytest.mark.parametrize("limit", [L.UPSTREAM_BYTES, 1])
def test_copies(spark, limit):
    rd = random.Random(1)
    theirs = "\n".join(f"def {rd.choice('abc')}{i}(p, q):\n    r = p * {rd.randint(1, 99)} + q\n    return s{i}(r)\n" for i in range(30))
    altered = "# moved\n" + theirs.replace("s3(", "t3(").replace("    ", "  ")
    files = spark.createDataFrame([("r/x.py", 1.0, altered), ("r/y.py", 1.0, HAND), ("r/x.py", 0.5, HAND), ("r/n.py", None, None), (None, 1.0, theirs)], FILE_SCHEMA)
    upstream = spark.createDataFrame([(1, "x.py", theirs), (2, "n.py", None)], "upstream_id int, file_name string, content string")
    assert {r.relative_path: r.reason for r in L.classify_files(files, upstream, limit).collect()} == {"r/x.py": "vendored", "r/y.py": None, "r/n.py": None}
    assert L.classify_files(files.limit(0), upstream, limit).count() == 0
    assert L.not_hand_written(files, upstream.limit(0)).count() == 0


def test_shingles_do_not_see_spacing_or_comments():
    assert (L.shingles("c", "int a = 1; /* x */ f(a);") == L.shingles("c", "int  a=1;\nf(a); // y")).all()
    assert len(L.shingles("c", "")) == 0 and len(L.shingles("c", "a")) == 1


def test_whole_layout():
    def word(i, n):
        return "".join(chr(97 + (i * 7 + j * j * 3 + i * j) % 26) for j in range(n))

    urls = "URLS = [\n" + "".join(f'    "https://{word(i, 20)}.example/{word(i + 1, 30)}/{word(i + 2, 28)}",\n' + ("" if i % 9 else f"    g{word(i, 3)}(\n") for i in range(400)) + "]\n"
    assert L.reason("r/a.py", urls) == "data"
    for path in ("r/a.py", "r/a.java", "r/a.go", "r/a.rs", "r/a.c", "r/a.cs", "r/a.rb", "r/a.sql"):
        assert L.reason(path, "".join(f"{word(i, 5)}=f({word(i, 4)},x);" for i in range(200))) == "minified"
    assert L.reason("r/a.c", "+-<>[]{}().,;:!?&|^~\n" * 60 + "int x;\n") == "data"
    assert L.reason("r/a.py", "T = {\n" + "".join(f"    k{i}: t('\u8bf7\u8f93\u5165\u59d3\u540d') + f(x),\n    g(y, z + {i}) or h,\n" for i in range(30)) + "}\n") is None
    assert L.reason("r/a.py", "Representational uncertainty circumscribes normalization transformations\n" + "notwithstanding parameterized hierarchies " * 40) is None


def test_copies_are_the_same_on_both_sides_of_the_limit(spark):
    """Random copies under known and unknown extensions, whole, altered and in part."""
    rd = random.Random(5)
    text = lambda k: "\n".join(f"call_{k}_{i}(a{i}, b) + {rd.randint(1, 999)}; // note {i}" for i in range(30))
    names = ["x.py", "y.jsx", "z", "w.JS", "v.c", "u.unknown", "py"]
    upstream = [(i, rd.choice(names), text(i)) for i in range(12)] + [(98, "n.py", None), (99, "e.py", "")]
    files = [("r/none.py", 1.0, None), ("r/empty.py", 1.0, "")]
    for i in range(60):
        theirs = rd.choice(upstream[:12])[2].split("\n")
        body = theirs[: rd.choice([30, 30, 27, 20, 8])] + (text(100 + i).split("\n")[: rd.choice([0, 2, 40])])
        files.append((f"r/f{i}{rd.choice(['.py', '.jsx', '.js', '.TS', '.md', '', '.c'])}", 1.0, "\n".join(body)))
    files, upstream = spark.createDataFrame(files, FILE_SCHEMA), spark.createDataFrame(upstream, "upstream_id int, file_name string, content string")
    order = lambda limit: sorted(map(str, L.classify_files(files, upstream, limit).collect()))
    want = order(L.UPSTREAM_BYTES)
    assert sum("vendored" in r for r in want) > 10 and order(1) == want


def test_markers_at_the_foot():
    assert L.reason("r/a.py", HAND + "\n# Code generated by x. DO NOT EDIT.\n") == "generated"
    assert L.reason("r/a.js", "f(a, b);\ng(c);\n\n/*\n * @generated from x\n */") == "generated"
    assert L.reason("r/a.py", HAND + "\n# Not generated: edit freely.\n") is None
    assert L.reason("r/a.py", HAND + "\n# Code generated by x. DO NOT EDIT.\nf(1)\n") is None
    assert L.reason("r/a.py", HAND + 'T = """\n# Code generated by x. DO NOT EDIT.\n"""\n') is None


def test_every_language_has_limits_of_its_own():
    line = "total = total + value_of(item, other);"
    for language, limits in L.LIMITS.items():
        packed = "a=b(c,d);" * (max(limits.longest, limits.mean) // 9 + 2)
        assert L.by_layout(language, packed) == "minified"
        assert L.by_layout(language, "\n".join([line] * 30)) is None
        assert L.by_layout(language, "x = [" + "1, 22, 333, 4444,\n" * 60 + "]") == "data"
    assert len(set(L.LIMITS.values())) >= 6
