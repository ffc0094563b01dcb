"""Wide text tables with one column for each of any number of entities."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.ordering import ranged_totals
from panelcast.session import cut_lineage

#: Columns that one task puts side by side at a time.
BLOCK = 1000


def _chunks(rows: DataFrame, block: int, count: int) -> DataFrame:
    """(o, ts, b, chunk): the values of one line and block of columns, comma by comma; ``rows`` are (o, ts, pos from 0, text)."""
    placed = rows.withColumn("b", F.floor(F.col("pos") / block).cast("int"))
    placed = placed.repartition("o", "ts", "b").sortWithinPartitions("o", "ts", "b", "pos").select("o", "ts", "b", "pos", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells = None, []

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*now, ",".join(cells)), (pa.int32(), pa.string(), pa.int32(), pa.string()), strict=True)], ["o", "ts", "b", "chunk"])

        for batch in batches:
            for o, ts, b, pos, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (o, ts, b) != now:
                    if now is not None:
                        yield done()
                    now, cells = (o, ts, b), [""] * (min(count, (b + 1) * block) - b * block)
                cells[pos - b * block] = text
        if now is not None:
            yield done()

    return placed.mapInArrow(run, "o int, ts string, b int, chunk string")


def wide_lines(rows: DataFrame, entity: str = "entity", ts: str = "ts", value: str = "value", block: int = BLOCK) -> DataFrame:
    """``(o, ts, line)``: the header (o = 0) and one comma-separated line for each ``ts`` (o = 1), columns in the order of the entities.

    Columns are numbered by a distributed order of the entities, put side by side in blocks, and the blocks of a line
    joined: neither plan nor driver knows a column's name. A cell without value is empty; of several
    values of one cell the largest counts. Names and times must hold no comma, quote or line end.
    """
    known = rows.select(F.col(entity).alias("e"), F.col(ts).cast("string").alias("ts"), F.col(value).alias("v")).where("e is not null and ts is not null")
    names = cut_lineage(ranged_totals(known.select("e").distinct(), [], [F.asc("e")], F.lit(1), "pos").select("e", (F.col("pos") - 1).alias("pos"), F.col("e").cast("string").alias("text")))
    count = names.count()
    odd = '[,"\r\n]'
    if names.where(F.col("text").rlike(odd)).limit(1).count() or known.where(F.col("ts").rlike(odd)).limit(1).count():
        raise ValueError("a column name or time holds a comma, a quote or a line end")
    cells = known.groupBy("ts", "e").agg(F.max("v").cast("string").alias("text")).where("text is not null").join(names.select("e", "pos"), "e")
    lines = known.select("ts").distinct()
    header = names.select(F.lit(0).alias("o"), F.lit(ts).alias("ts"), "pos", "text")
    chunks = _chunks(header.unionByName(cells.select(F.lit(1).alias("o"), "ts", "pos", "text")), block, count)
    packed = chunks.groupBy("o", "ts").agg(F.map_from_entries(F.collect_list(F.struct("b", "chunk"))).alias("c"))
    every = lines.select(F.lit(1).alias("o"), "ts").union(names.limit(1).select(F.lit(0), F.lit(ts)))
    blocks = -(-count // block)
    empty = lambda b: F.repeat(F.lit(","), F.least(F.lit(count), (b + 1) * block) - b * block - 1)
    whole = F.concat_ws(",", F.transform(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))), lambda b: F.coalesce(F.try_element_at("c", b), empty(b))))
    return every.join(packed, ["o", "ts"], "left").select("o", "ts", F.concat(F.col("ts"), F.lit(","), whole).alias("line"))


def write_wide(rows: DataFrame, path: str, entity: str = "entity", ts: str = "ts", value: str = "value", block: int = BLOCK) -> None:
    """Text directory of ``wide_lines``: the header first, then the lines in order of time across the part files."""
    lines = wide_lines(rows, entity, ts, value, block)
    lines.repartitionByRange("o", "ts").sortWithinPartitions("o", "ts").select("line").write.text(path)


def read_wide(spark: SparkSession, path: str, ts: str = "ts") -> DataFrame:
    """``(ts, entity, value)`` strings of the filled cells of a directory that ``write_wide`` made."""
    lines = spark.read.text(path).select(F.split("value", ",", -1).alias("c"))
    own = F.col("c")[0] == F.lit(ts)
    rest = F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(1)))
    names = lines.where(own).select(F.posexplode(rest).alias("pos", "entity"))
    cells = lines.where(~own).select(F.col("c")[0].alias(ts), F.posexplode(rest).alias("pos", "value")).where("value <> ''")
    return cells.join(names, "pos").select(ts, "entity", "value")
