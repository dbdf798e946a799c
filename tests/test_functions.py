import pytest
from millrace.functions import errors, paths, scalars
from millrace.operators import topics
from pyspark.sql import functions as F

#: path, canonical form, bad as a topic, bad as a pattern
PATHS = [
    ("", None, True, True), ("/", None, True, True), ("a", "a", False, False), ("/a", "a", False, False), ("a/", None, True, True),
    ("a//b", None, True, True), ("a/b", "a/b", False, False), ("*", "*", True, False), ("a/*/b", "a/*/b", True, False),
    ("**", "**", True, False), ("a/**", "a/**", True, False), ("a/**/b", "a/**/b", True, True), ("a/b*", "a/b*", True, True),
    ("***", "***", True, True), ("//a", None, True, True), (None, None, True, True), ("a/**/**", "a/**/**", True, True),
]


def test_paths(spark):
    p = F.col("p")
    df = spark.createDataFrame([(x,) for x, *_ in PATHS], "p string")
    got = df.select("p", F.when(paths.path_error(p).isNull(), paths.canonical(p)), paths.topic_error(p).isNotNull(), paths.pattern_error(p).isNotNull(), paths.topic_error(p).alias("e"))
    for row, want in zip(got.collect(), PATHS, strict=True):
        assert tuple(row)[:4] == want
        assert row.e is None or (row.e.kind, row.e.permanent) == ("invalid_path", True)


PATTERNS = ["a/b", "a/*", "*/b", "a/**", "**", "a/b/c", "*/*/c", "x/*/**", "/a/b", "a//b"]
TOPICS = ["a", "a/b", "/a/b", "a/b/c", "x", "x/y", "x/y/z/w", "q/b", "b*", "", "a/b/c/d/e/f/g/h/i", "z/b/c"]


def plainly(topic, pattern):
    t, p = topic.strip("/").split("/"), pattern.split("/")
    if p[-1] == "**":
        return len(t) >= len(p) - 1 and all(b in ("*", a) for a, b in zip(t, p[:-1], strict=False))
    return len(t) == len(p) and all(b in ("*", a) for a, b in zip(t, p, strict=True))


def test_match_equals_brute_force(spark):
    sends = spark.createDataFrame(list(enumerate(TOPICS)), "seq long, topic string")
    patterns = spark.createDataFrame([(p,) for p in PATTERNS], "pattern string")
    got = sorted((r.topic, r.pattern) for r in topics.match(sends, patterns).collect())
    valid = {p for p in PATTERNS if "//" not in p and p[0] != "/"}
    assert got == sorted((t, p) for t in TOPICS for p in valid if t and "*" not in t and plainly(t, p))
    m = topics.metrics(sends, patterns).first()
    assert (m.sends, m.matches, m.topics) == (10, len(got), len(valid))


def test_candidates_equal_the_comparison(spark):
    rows = [(t, p) for t in TOPICS if t and "*" not in t and t.count("/") < 6 for p in PATTERNS if "//" not in p and p[0] != "/"]
    df = spark.createDataFrame(rows, "t string, p string")
    got = df.select(F.array_contains(paths.candidate_keys(F.col("t")), F.col("p")).alias("a"), paths.matches(F.col("t"), F.col("p")).alias("b")).collect()
    assert all(r.a == r.b for r in got)


def test_scalars(spark):
    df = spark.createDataFrame([("**", "", " x \t", bytearray(b"abc"), 5), ("?", " ", "", bytearray(b""), 0), ("***", "2020-01-02 03:04:05", "y", bytearray(b"\x00\xff"), 9)], "l string, t string, s string, b binary, n long")
    rows = df.select(scalars.parse_level(F.col("l")), scalars.parse_time(F.col("t")).cast("string"), scalars.trim_space(F.col("s")), scalars.reverse_bytes(F.col("b")), scalars.bit(F.col("n"), F.lit(0)), scalars.set_bit(F.col("n"), F.lit(1)), scalars.op_name(F.col("n").cast("int"))).collect()
    assert [tuple(r)[:3] for r in rows] == [(2, "0001-01-01 00:00:00", "x"), (-1, None, ""), (3, "2020-01-02 03:04:05", "y")]
    assert [bytes(r[3]) for r in rows] == [b"cba", b"", b"\xff\x00"]
    assert [tuple(r)[4:] for r in rows] == [(True, 7, "Op(5)"), (False, 2, "UnknownOp"), (True, 11, "Op(9)")]


def test_lanes_and_kinds(spark):
    with pytest.raises(ValueError):
        scalars.lane(F.lit("a"), 0)
    with pytest.raises(ValueError):
        errors.error("odd", "x")
