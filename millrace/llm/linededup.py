"""Line dedup by site-relative frequency.

A line is boilerplate of its host if more than ``ratio`` of the host's pages hold it, and at least
``min_pages`` do. Boilerplate lines are dropped from every page of that host.

Plan: each page gives its distinct lines as 128-bit hashes; (host, line) counts are summed map-side before
they are shuffled, so a hot line or host costs one row a task. Because a line counts only where it holds
over a fixed part of the pages, a host has at most (mean distinct lines a page) / ratio of them, however
many pages it has; those go back to the pages as one array a host. The planner broadcasts that table if its
written size allows; else the pages are joined on (host, salt), so a hot host is spread over SALTS tasks.

With ``distinct`` each text of a host counts as one page in both terms, and a page that would lose all its
lines keeps them: copies of a page, exact or near, don't make its own lines boilerplate and vanish together.

Cases: a null text stays null, with no lines; an empty or blank line is never boilerplate; null hosts are
one host of their own; repeated rows count as pages of their own; other columns stay as they are, whatever
their names, but that __lines and __dropped are the counts; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stash

RATIO, MIN_PAGES, SALTS = 0.08, 5, 32


def _key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(line, F.lit(1)).alias("b"))


def boilerplate(pages: DataFrame, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """host, bad: the hashes of the lines that exceed the ratio on that host."""
    body = F.col(f"`{text}`")
    page = pages.select(F.col(f"`{host}`").alias("host"), F.split(body, "\n").alias("lines"), *([_key(body).alias("page")] if distinct else []))
    kept = F.filter("lines", lambda x: F.trim(x) != "")
    seen = page.select("host", *(["page"] if distinct else []), F.explode(F.array_distinct(F.transform(kept, _key))).alias("line"))
    if distinct:  # a text's hash goes with its lines, not the text
        seen, page = seen.distinct(), page.select("host", "page").distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = page.groupBy("host").agg(F.count("*").alias("pages")).withColumnRenamed("host", "of")
    over = counts.join(totals, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return over.groupBy("host").agg(F.collect_list("line").alias("bad"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, distinct: bool = False) -> DataFrame:
    """The pages with ``text`` cleaned; __lines and __dropped count the lines before and those that went."""
    # only the columns that are used get new names, which no column of the input has
    free = lambda name: next(x for x in (name + "_" * n for n in range(len(pages.columns) + 1)) if x not in pages.columns)
    of, gone, part, salt, clean = (free(f"__{x}") for x in ("host", "bad", "part", "salt", "clean"))
    bad = stash(boilerplate(pages, host, text, ratio, min_pages, distinct))
    spread = bad.select(F.col("host").alias(of), F.col("bad").alias(gone), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(part))
    salted = pages.withColumn(salt, F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in (host, text))), F.lit(SALTS)).cast("int"))
    joined = salted.join(spread, F.col(f"`{host}`").eqNullSafe(F.col(of)) & (F.col(salt) == F.col(part)), "left")
    lines = F.split(F.col(f"`{text}`"), "\n")
    left = F.when(F.col(gone).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(gone, _key(x))))
    if distinct:
        left = F.when(F.exists(left, lambda x: F.trim(x) != ""), left).otherwise(lines)
    out = joined.withColumn(clean, left)
    none = F.col(f"`{text}`").isNull()
    before = F.when(none, F.lit(0)).otherwise(F.size(lines)).cast("long")
    dropped = F.when(none, F.lit(0)).otherwise(F.size(lines) - F.size(clean)).cast("long")
    kept = [F.array_join(clean, "\n").alias(c) if c == text else F.col(f"`{c}`") for c in pages.columns if c not in ("__lines", "__dropped")]
    return out.select(*kept, before.alias("__lines"), dropped.alias("__dropped"))


def query(spark, sf_dir):
    from millrace.llm.common import only, read

    docs = only(read(spark, sf_dir, "documents"), doc_id="doc_id", source="source", text="text")
    return drop_boilerplate(docs, "source").withColumnsRenamed({"__lines": "n_lines", "__dropped": "n_dropped"})


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT source, unnest(list_distinct(lines)) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY source, line),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
b AS (SELECT c.source, list(c.line) AS bad FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
      WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO}::DOUBLE * p.pages GROUP BY c.source),
k AS (SELECT d.doc_id, d.source, d.lines,
             list_filter(d.lines, lambda x: NOT list_contains(coalesce(b.bad, []), x)) AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text,
       coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped
FROM k
"""
