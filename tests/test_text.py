"""Text expressions against Python's own string semantics."""

from pyspark.sql import functions as F

from trapwise.functions import text as T

WS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        　"


def _one(spark, col, value):
    return spark.createDataFrame([(value,)], "t string").select(col.alias("x")).first()["x"]


def test_ustrip_matches_python(spark):
    samples = [WS + "a b" + WS, "  x  ", "　y ", "no-strip", "", WS]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["x"] for r in df.select(T.ustrip("t").alias("x")).collect()]
    assert got == [s.strip() for s in samples]


def test_title_matches_splitlines(spark):
    samples = ["Title line\nbody", "\nleading newline", "a\rb", "x\x0by", "p q", "one line  ", "c\x1cd"]
    df = spark.createDataFrame([(s,) for s in samples], "t string")
    got = [r["x"] for r in df.select(T.title_of("t").alias("x")).collect()]
    assert got == [s.splitlines()[0].strip() for s in samples]
    assert _one(spark, T.title_of(F.col("t")), "") is None


def test_tokenize_lower_then_ascii(spark):
    got = _one(spark, T.tokenize("t"), "Héllo WORLD-42 naïve")
    assert got == ["h", "llo", "world", "42", "na", "ve"]


def test_compose_text(spark):
    df = spark.createDataFrame([("T", "body"), ("T", "T body"), ("", "body"), (None, " b "), (" T ", "")],
                               "ti string, d string")
    got = [r["x"] for r in df.select(T.compose_text("ti", "d").alias("x")).collect()]
    assert got == ["T\nbody", "T body", "body", "b", "T\n"]


def test_rule_decompose_forms(spark):
    rows = [("Apple pie excluding cherry tart?",), ("Except for dogs, which pets live long?",),
            ("films without violence except gore",), ("plain query",), ("mostly without",)]
    df = spark.createDataFrame(rows, "q string")
    t, p = T.rule_decompose("q")
    got = [(r["t"], r["p"]) for r in df.select(t.alias("t"), p.alias("p")).collect()]
    assert got[0] == ("Apple pie", "cherry tart")
    assert got[1] == ("which pets live long", "dogs")
    assert got[2] == ("films", "violence except gore")  # first wrapper splits
    assert got[3] == ("plain query", "")
    assert got[4] == ("mostly without", "")  # no excluded phrase after the wrapper


def test_rule_split_keeps_the_trap_of_a_multi_line_query(spark):
    df = spark.createDataFrame([("birds in\nSpain without eagles",), ("Excluding old\nmaps, new\nones",)], "q string")
    t, p = T.rule_decompose("q")
    assert [tuple(r) for r in df.select(t, p).collect()] == [("birds in\nSpain", "eagles"), ("new\nones", "old\nmaps")]
    assert [tuple(r) for r in T.decompose_frame(df, "q").collect()] == [("birds in\nSpain", "eagles"), ("new\nones", "old\nmaps")]
