"""Problem 8: held-out samples, and what counts as prose."""

from tracegrove.llm import reading_level as R


def test_held_out_samples(spark, data):
    rows = spark.read.parquet(f"{data}/level_samples.parquet").orderBy("sample_id").collect()
    right = 0
    for held in range(10):  # ten folds
        model = R.Levels([(r.level, r.text) for i, r in enumerate(rows) if i % 10 != held])
        part = [r for i, r in enumerate(rows) if i % 10 == held]
        right += sum(g == r.level for g, r in zip(model.score([r.text for r in part])[1], part))
    assert right >= 0.95 * len(rows)


PROSE = "The old menu opens the box. This line\nkeeps the small note. Sort the list for you! One page\nshows the name. A new step marks the file."


def n(text):
    model = R.Levels([(1, PROSE), (2, PROSE)])
    return int(model.score([text])[0][0])


def test_what_is_prose():
    assert n(PROSE) == 5
    assert n("# A heading. Not prose.\n\n- The tool reads a file.\n- This box keeps the list.\n") == 2
    assert n("```\nThe code is not prose. It is code.\n```\n\nThe text is prose.") == 1
    assert n("| a | b |\n|---|---|\n| The cell is long. | This too is one. |\n") == 0
    assert n("2025-01-01 INFO The job is done.\n2025-01-01 WARN The job is late.\n") == 0
    assert n("`a_b` `c_d` `e_f`\n\n- merge the open queue (a1b2c3)\n") == 0
    assert n("Die Suche speichert alle Verweise. Das ist der Text. Die Seite zeigt den Namen.") == 0
    assert n("def f(a):\n    # The function is long. It is a test.\n    return a\n\nx = f(1)\ny = 2\n") == 0
    assert n(None) == n("") == n(" \n ") == 0


def test_operator(spark, data):
    samples = spark.read.parquet(f"{data}/level_samples.parquet")
    rows = [(1, PROSE), (1, PROSE), (2, None), (3, ""), (4, "This is short. So is this."), (None, PROSE)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as level", "8 as sentences")
    got = sorted(((r.doc_id or 0, r.sentences, r.level) for r in R.reading_levels(docs, samples).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (2, 0, None), (3, 0, None), (4, 2, None), (0, 5, 1)], key=str)
    assert R.reading_levels(docs.limit(0), samples).count() == 0


def test_long_text_is_read_to_its_end():
    model = R.Levels([(1, PROSE), (2, PROSE)])
    assert model.score([(PROSE + "\n\n") * 3000])[0][0] == 15_000
