"""The given tables and the panel-shaped views that every query derives from them.

Each view exists twice with the same meaning: as a DataFrame (``Tables``) and as a SQL common table
expression (``CTE``), so that a query and its check SQL start from identical rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.aggregate import in_even_parts
from panelcast.operators.reshape import to_wide

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
FEATURES = ["quantity", "discount", "tax", "retailprice", "size"]
DAILY = ["d_qty", "d_disc", "d_tax", "d_lines", "d_price", "d_ret"]
EMB_DIM = 64


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem")

    @cached_property
    def panel(self) -> DataFrame:
        """entity = supplier, one row per supplier and day with sales."""
        lines = self.lineitem.select(F.col("l_suppkey").alias("entity"), F.to_date("l_shipdate").alias("ts"), "l_extendedprice")
        return in_even_parts(lines, ["entity", "ts"]).groupBy("entity", "ts").agg(F.round(F.sum("l_extendedprice"), 2).alias("value"))

    @cached_property
    def total(self) -> DataFrame:
        """One row per day over all suppliers, in hundredths."""
        return self.lineitem.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
            F.round(F.sum("l_extendedprice") * 100).alias("value")
        )

    @cached_property
    def dense(self) -> DataFrame:
        """Two long gap-free series in hundredths: entity = line status."""
        daily = self._daily(F.col("l_linestatus").alias("entity"))
        return daily.withColumn("value", F.round(F.col("value") * 100))

    @cached_property
    def cents(self) -> DataFrame:
        """The panel in hundredths: whole numbers, so sums do not depend on their order."""
        return self.panel.withColumn("value", F.round(F.col("value") * 100))

    def _daily(self, entity) -> DataFrame:
        return self.lineitem.groupBy(entity, F.to_date("l_shipdate").alias("ts")).agg(
            F.round(F.sum("l_extendedprice"), 2).alias("value")
        )

    @cached_property
    def ev(self) -> DataFrame:
        """Short dense panel: entity = event type, one row per day."""
        return (
            self.table("events")
            .groupBy(F.col("event_type").alias("entity"), F.to_date("ts").alias("ts"))
            .agg(F.round(F.sum("value"), 2).alias("value"))
        )

    @cached_property
    def wide(self) -> DataFrame:
        """``ev`` as one row per day and one column per event type."""
        return to_wide(self.ev, ["ts"], "entity", "value", EVENT_TYPES)

    @cached_property
    def daily(self) -> DataFrame:
        """Wide table of daily predictors, one row per day."""
        li = self.lineitem
        return li.groupBy(F.to_date("l_shipdate").alias("ts")).agg(
            F.round(F.sum("l_quantity"), 2).alias("d_qty"),
            F.round(F.sum("l_discount"), 2).alias("d_disc"),
            F.round(F.sum("l_tax"), 2).alias("d_tax"),
            F.count("*").cast("double").alias("d_lines"),
            F.max("l_extendedprice").alias("d_price"),
            F.sum(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("d_ret"),
        )

    @cached_property
    def feat(self) -> DataFrame:
        """One row per order line: target ``y``, five predictors, unique key columns, a group."""
        part = self.table("part").select("p_partkey", "p_retailprice", "p_size")
        return self.lineitem.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_linestatus").alias("grp"),
            F.to_date("l_shipdate").alias("ts"),
            F.col("l_extendedprice").alias("y"),
            F.col("l_quantity").alias("quantity"),
            F.col("l_discount").alias("discount"),
            F.col("l_tax").alias("tax"),
            F.col("p_retailprice").alias("retailprice"),
            F.col("p_size").cast("double").alias("size"),
        )

    @cached_property
    def holes(self) -> DataFrame:
        """Order lines with nulls in two columns (see the literals)."""
        return self.lineitem.select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
            F.col("l_extendedprice").alias("price"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_tax") != 0.0, F.col("l_tax")).alias("tax"),
            F.when(F.col("l_discount") != 0.05, F.col("l_discount")).alias("discount"),
        )

    @cached_property
    def dim(self) -> DataFrame:
        """Positions of the suppliers."""
        k = F.col("s_suppkey")
        return self.table("supplier").select(
            k.alias("entity"),
            (F.lit(33.83) + (k % 37) * F.lit(0.085)).alias("lat"),
            (F.lit(-102.88) + ((k * 7) % 97) * F.lit(0.085)).alias("lon"),
            (F.lit(110) + (k * 53) % 1213).cast("int").alias("elev"),
        )

    @cached_property
    def clusters(self) -> DataFrame:
        """A fixed entity to cluster map."""
        return self.table("supplier").select(
            F.col("s_suppkey").alias("entity"), (F.col("s_suppkey") % 8 + 1).cast("int").alias("cluster")
        )

    @cached_property
    def emb(self) -> DataFrame:
        """Embeddings as one array<double> column."""
        return self.table("embeddings").select(
            "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
        )


CTE = {
    "panel": """SELECT l_suppkey AS entity, CAST(l_shipdate AS DATE) AS ts,
        ROUND(SUM(l_extendedprice), 2) AS value FROM lineitem GROUP BY 1, 2""",
    "total": """SELECT CAST(l_shipdate AS DATE) AS ts, ROUND(SUM(l_extendedprice) * 100) AS value
        FROM lineitem GROUP BY 1""",
    "dense": """SELECT l_linestatus AS entity, CAST(l_shipdate AS DATE) AS ts,
        ROUND(ROUND(SUM(l_extendedprice), 2) * 100) AS value FROM lineitem GROUP BY 1, 2""",
    "cents": "SELECT entity, ts, ROUND(value * 100) AS value FROM panel",
    "ev": """SELECT event_type AS entity, CAST(ts AS DATE) AS ts, ROUND(SUM(value), 2) AS value
        FROM events GROUP BY 1, 2""",
    "wide": "SELECT ts, " + ", ".join(
        f"MAX(CASE WHEN entity = '{e}' THEN value END) AS \"{e}\"" for e in EVENT_TYPES
    ) + " FROM ev GROUP BY ts",
    "daily": """SELECT CAST(l_shipdate AS DATE) AS ts, ROUND(SUM(l_quantity), 2) AS d_qty,
        ROUND(SUM(l_discount), 2) AS d_disc, ROUND(SUM(l_tax), 2) AS d_tax,
        CAST(COUNT(*) AS DOUBLE) AS d_lines, MAX(l_extendedprice) AS d_price,
        SUM(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS d_ret
        FROM lineitem GROUP BY 1""",
    "feat": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus AS grp,
        CAST(l_shipdate AS DATE) AS ts, l_extendedprice AS y, l_quantity AS quantity,
        l_discount AS discount, l_tax AS tax, p_retailprice AS retailprice,
        CAST(p_size AS DOUBLE) AS size FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "holes": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS price,
        l_quantity AS quantity, CASE WHEN l_tax <> 0.0 THEN l_tax END AS tax,
        CASE WHEN l_discount <> 0.05::DOUBLE THEN l_discount END AS discount FROM lineitem""",
    "dim": """SELECT s_suppkey AS entity, 33.83::DOUBLE + (s_suppkey % 37) * 0.085::DOUBLE AS lat,
        -102.88::DOUBLE + ((s_suppkey * 7) % 97) * 0.085::DOUBLE AS lon,
        CAST(110 + (s_suppkey * 53) % 1213 AS INTEGER) AS elev FROM supplier""",
    "clusters": """SELECT s_suppkey AS entity, CAST(s_suppkey % 8 + 1 AS INTEGER) AS cluster
        FROM supplier""",
    "emb": """SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings""",
}
NEEDS = {"wide": ["ev"], "cents": ["panel"]}


def with_views(names: str, body: str) -> str:
    """``WITH`` clause for the named views followed by ``body`` (which may add its own after a comma)."""
    wanted: list[str] = []
    for name in names.split():
        for need in NEEDS.get(name, []) + [name]:
            if need not in wanted:
                wanted.append(need)
    head = ", ".join(f"{n} AS ({CTE[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {head}{body}" if body.startswith(",") else f"WITH {head} {body}"
