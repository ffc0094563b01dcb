"""Line dedup by site-relative frequency, on built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.llm.sized import small_left_join
from panelcast.session import cut_lineage

#: A line on more than this share of a site's pages is boilerplate.
RATIO = 0.1
#: Pages a site needs before shares are judged.
MIN_PAGES = 10


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _mark(line: Column) -> Column:
    """64-bit hash of a line without its outer blanks; null for a blank line, which is never boilerplate."""
    return F.when(F.trim(line) != "", F.xxhash64(F.trim(line)))


def boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, marks): hashes of the lines that more than ``ratio`` of a site's pages contain.

    A page counts once for a line however often it repeats it. Pages with null text count as pages.
    Counts are summed map-side before the shuffle; a site has at most (lines per page / ratio) marks.
    """
    pages = docs.select(F.col(site_col).cast("string").alias("site"), F.col(text_col).alias("text"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    marks = pages.select("site", F.explode(F.array_distinct(F.transform(_lines(F.col("text")), _mark))).alias("mark")).where("mark is not null")
    counts = marks.groupBy("site", "mark").agg(F.count("*").alias("n")).where(F.col("n") > ratio * min_pages)
    often = counts.join(totals.withColumnRenamed("site", "s"), F.col("site").eqNullSafe(F.col("s"))).where(F.col("n") / F.col("pages") > ratio)
    return often.groupBy("site").agg(F.collect_list("mark").alias("marks"))


def without_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text; all other columns stay, whatever their names.

    Every row stays: a text of boilerplate only becomes empty, a null text stays null.
    A null site is a site of its own; sites under ``min_pages`` lose nothing. An empty table stays empty.
    """
    return _cleaned(docs, site_col, text_col, ratio, min_pages).drop("n_lines", "n_dropped").toDF(*docs.columns)


def drop_boilerplate(docs: DataFrame, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``without_boilerplate`` with ``n_lines`` and ``n_dropped`` of each row, 0 for a null text; columns of these names are replaced."""
    kept = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return _cleaned(docs.select(*kept), site_col, text_col, ratio, min_pages).toDF(*kept, "n_lines", "n_dropped")


def _cleaned(docs: DataFrame, site_col: str, text_col: str, ratio: float, min_pages: int) -> DataFrame:
    """Columns c0, c1, ... in place of those of ``docs``, then n_lines and n_dropped."""
    site, text = (f"c{docs.columns.index(c)}" for c in (site_col, text_col))
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    marks = cut_lineage(boilerplate(rows, site, text, ratio, min_pages)).select(F.col("site").alias("_site"), F.col("marks").alias("_marks"))
    joined = small_left_join(rows, marks, F.col(site).cast("string").eqNullSafe(F.col("_site")), F.size("_marks"))
    lines = _lines(F.col(text))
    kept = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_marks"), _mark(x)), F.lit(False)))
    out = joined.withColumn("_kept", F.when(F.col("_marks").isNotNull(), kept))
    n = F.coalesce(F.size(lines), F.lit(0))
    return out.select(
        *(F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text)).alias(c) if c == text else c for c in rows.columns),
        F.when(F.col(text).isNull(), 0).otherwise(n).alias("n_lines"),
        F.when(F.col("_kept").isNotNull(), n - F.size("_kept")).otherwise(0).alias("n_dropped"),
    )


def check_sql(ratio: float = RATIO, min_pages: int = MIN_PAGES) -> str:
    """The same on ``documents`` in SQL, lines compared as text."""
    return f"""
with p as (select doc_id, source, text, string_split(text, chr(10)) as ls from documents),
t as (select source, count(*) as pages from p group by source),
l as (select distinct doc_id, source, trim(x, ' ') as line from (select doc_id, source, unnest(ls) as x from p) where trim(x, ' ') <> ''),
b as (select l.source, line from l join t on l.source is not distinct from t.source where pages >= {min_pages}
      group by l.source, line, pages having count(*) / pages > {ratio}),
s as (select source, list(line) as drops from b group by source),
k as (select p.*, list_filter(ls, lambda x: not coalesce(list_contains(drops, trim(x, ' ')), false)) as kept from p left join s on p.source is not distinct from s.source)
select doc_id, case when text is null then null else array_to_string(kept, chr(10)) end as text,
       cast(coalesce(len(ls), 0) as integer) as n_lines, cast(coalesce(len(ls) - len(kept), 0) as integer) as n_dropped from k"""
