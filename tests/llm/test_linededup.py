import random
from collections import Counter, defaultdict

from millrace.llm import linededup

LINES = ["menu", "home | about", "", "  ", "é foot"]


def brute(pages, ratio, least):
    hosts, seen = Counter(h for h, _ in pages), defaultdict(Counter)
    for h, t in pages:
        if t is not None:
            seen[h].update({x for x in t.split("\n") if x.strip(" ")})
    bad = {h: {x for x, n in c.items() if n >= least and n > ratio * hosts[h]} for h, c in seen.items()}
    out = []
    for h, t in pages:
        kept = None if t is None else [x for x in t.split("\n") if x not in bad[h]]
        out.append((h or "-", "-" if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(kept)))
    return sorted(out)


def test_equals_brute_force(spark):
    r = random.Random(0)
    pages = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, ""]) if r.random() < 0.05 else "\n".join(r.choice([*LINES, f"own {i}", f"half {i % 7}"]) for _ in range(r.randint(1, 9)))) for i in range(300)]
    pages += pages[:20]
    df = spark.createDataFrame([(h, t, 1, 2) for h, t in pages], "host string, text string, line int, bad int")
    for ratio, least in ((0.3, 5), (0.05, 1)):
        got = linededup.drop_boilerplate(df, ratio=ratio, min_pages=least)
        assert got.columns == [*df.columns, "__lines", "__dropped"]
        assert sorted((x.host or "-", "-" if x.text is None else x.text, x["__lines"], x["__dropped"]) for x in got.collect()) == brute(pages, ratio, least)


def test_empty_table(spark):
    assert linededup.drop_boilerplate(spark.createDataFrame([], "host string, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([("a", "x\ny")], "host string, text string")
    plan = linededup.drop_boilerplate(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns_with_names_of_its_own(spark):
    rows = [("a", f"menu\nown {i}", 7, 8, 9, 10, 11) for i in range(9)] + [(None, None, 1, 1, 1, 1, 1)]
    df = spark.createDataFrame(rows, "__host string, text string, __salt int, __bad int, __part int, __clean int, __lines int")
    got = linededup.drop_boilerplate(df, "__host", distinct=True).collect()
    assert sorted((r.text or "", r["__salt"], r["__bad"], r["__clean"], r["__lines"], r["__dropped"]) for r in got) == [("", 1, 1, 1, 0, 0)] + [(f"own {i}", 7, 8, 10, 2, 1) for i in range(9)]
