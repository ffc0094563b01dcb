"""Filling missing values."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.operators.models.linear import solve_moments
from panelcast.operators.moments import column_means, gram, gram_matrix
from panelcast.operators.quantiles import exact_quantiles
from panelcast.operators.reshape import to_long
from panelcast.operators.splits import hash_uniform
from panelcast.session import remove_scratch, scratch_path


def impute_simple(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    """Column mean or median into the gaps (one number per column)."""
    if how == "mean":
        row = df.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    elif how == "median":
        long = to_long(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols, "c", "v")
        row = {r["c"]: r["m"] for r in exact_quantiles(long, ["c"], "v", [0.5], ["m"]).collect()}
    else:
        raise ValueError("how is 'mean' or 'median'")
    return df.fillna({c: float(v) for c, v in row.items() if v is not None})


def impute_pmm(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], m: int = 5, maxit: int = 5, donors: int = 5, seed: int = 42
) -> DataFrame:
    """Chained equations with predictive-mean matching; returns m completed tables stacked by ``imp``.

    All m chains run together. Rows without gaps are the same in all chains: they are stored once, and their moments
    are taken once. Only the rows with gaps are kept for each chain and written anew after a draw. Per sweep and
    incomplete column: moments of the observed rows, coefficients and a draw around them per chain, predictions, then
    the donors. The nearest ``donors`` of a missing row lie among the ``donors`` observed rows on either side of its
    place in the order of the predictions, so a task that goes through a stretch of that order finds them (``_donors``).
    Observed rows travel to their stretch as blocks of numbers (``_dealt``) and are put in order there.
    """
    keys, cols = list(keys), list(cols)
    spark = df.sparkSession
    counts = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    holes = [c for c in cols if counts[c]]
    marked = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).withColumns(
        {f"_na_{c}": F.col(c).isNull() for c in holes}
    )
    chains = F.explode(F.sequence(F.lit(1), F.lit(m)))
    if not holes or not maxit:
        return impute_simple(marked, cols).withColumn("imp", chains).select("imp", *keys, *cols)
    base = _stored(impute_simple(marked, cols), "pmm-rows")
    gaps = reduce(lambda x, y: x | y, [F.col(f"_na_{c}") for c in holes])
    whole, gappy = base.where(~gaps).select(*keys, *cols), base.where(gaps)
    twice = gappy.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys, F.lit(True).alias("_twice"))
    state, path = _store(gappy.join(twice, keys, "left").withColumn("imp", chains), "pmm-gaps")
    at = column_means(base, cols)
    some = base.sample(min(1.0, SAMPLE / max(1, counts["_n"])), seed).select(*cols, *[f"_na_{c}" for c in holes]).toPandas()  # where to part the order, no more
    stretches = max(-(-counts["_n"] // STRETCH_ROWS), -(-spark.sparkContext.defaultParallelism // m))
    fixed = gram_matrix(gram(whole, cols, (), at).toPandas(), len(cols) + 1)
    sums = np.array(whole.agg(*[F.sum(c) for c in cols]).first(), dtype=float) if fixed[0, 0] else np.zeros(len(cols))
    for sweep in range(maxit):
        for c in holes:
            order = [*[x for x in cols if x != c], c]
            known = [cols.index(x) for x in order]
            row = state.agg(F.count("*"), *[F.sum(x) for x in order]).first()
            n = m * fixed[0, 0] + row[0]
            shift = [(m * sums[k] + (v or 0.0)) / n for k, v in zip(known, row[1:])]
            moments = _shifted(fixed[np.ix_([0, *[k + 1 for k in known]], [0, *[k + 1 for k in known]])], [at[k] - s for k, s in zip(known, shift)])
            drawn, held = _draw_column(whole, state, keys, c, order, donors, seed + 1000 * sweep, moments, shift, m, some, stretches)
            state, new = _store(
                state.join(drawn, ["imp", *keys], "left")
                .withColumn(c, F.when(F.col(f"_na_{c}"), F.coalesce("_new", c)).otherwise(F.col(c)))
                .drop("_new"),
                "pmm-gaps",
            )
            for old in (path, held):
                remove_scratch(spark, old)
            path = new
    return whole.withColumn("imp", chains).select("imp", *keys, *cols).unionByName(state.select("imp", *keys, *cols))


def _store(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written below the shared folder and read again, and its path."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _stored(df: DataFrame, name: str) -> DataFrame:
    return _store(df, name)[0]


def _shifted(g: np.ndarray, by: Sequence[float]) -> np.ndarray:
    """Sums of products of ``[1, x + by]`` from those of ``[1, x]``."""
    t = np.eye(len(g))
    t[1:, 0] = by
    return t @ g @ t.T


def _draw_column(
    whole: DataFrame, state: DataFrame, keys: list[str], c: str, order: list[str], donors: int, seed: int, moments: np.ndarray, shift: list[float], m: int,
    some: pd.DataFrame, stretches: int,
) -> tuple[DataFrame, str]:
    """``imp, keys, _new`` for the rows in which ``c`` is missing, and the path of what it reads.

    ``moments`` are those of the rows without gaps, which every chain has.
    """
    spark, others, size = whole.sparkSession, order[:-1], len(order) + 1
    cells = gram(state.where(~F.col(f"_na_{c}")), order, ["imp"], shift).toPandas()
    models = {}
    for imp in range(1, m + 1):
        g = moments + gram_matrix(cells[cells["imp"] == imp], size)
        if g[0, 0] <= 0:
            continue
        beta = solve_moments(g, "ols", {}, shift)
        # draw around the estimate: residual variance, then a normal step with the inverse moments
        rng = np.random.default_rng(seed + imp)
        v = np.concatenate([[-(beta[0] + beta[1:] @ np.asarray(shift[:-1]) - shift[-1])], -beta[1:], [1.0]])
        dof = max(g[0, 0] - size + 1, 1.0)
        sigma = np.sqrt(max(float(v @ g @ v), 0.0) / rng.chisquare(dof))
        inv = np.linalg.pinv(g[:-1, :-1], hermitian=True)
        vals, vecs = np.linalg.eigh(inv)
        step = sigma * vecs @ (np.sqrt(np.clip(vals, 0, None)) * rng.standard_normal(size - 1))
        models[imp] = beta, beta + np.concatenate([[step[0] - step[1:] @ np.asarray(shift[:-1])], step[1:]])
    h, value = F.xxhash64(*keys, F.lit(seed)).alias("_h"), F.col(c).alias("_v")
    named = reduce(lambda x, y: x & y, [F.col(k).isNotNull() for k in keys])  # a row without a key can't be met again
    key = F.struct(*keys, "_twice", hash_uniform([*keys, "imp"], c, seed).alias("_u"))
    missing = F.col(f"_na_{c}")
    one = state.where(F.col("imp").isin(list(models)) & (~missing | named))
    own = one.select("imp", *others, missing.alias("_na"), h, value, F.when(missing, key).alias("_k"))
    bounds = _bounds(some, c, others, models, stretches, seed)
    placed = _dealt(whole.select(*others, h, value), own, others, models, bounds, stretches)
    found, held = _store(_donors(placed, donors, sorted(models), stretches), "pmm-donors")

    # the first and last observed rows of every stretch, for the missing rows near its ends
    edges: dict = {}
    for r in found.where("_kind = 2").select("imp", "_r", "_c").collect():
        edges.setdefault(r["imp"], {})[r["_r"]] = sorted((x["at"], x["p"], x["v"]) for x in r["_c"])
    every = {imp: sorted(x for part in stretches.values() for x in part) for imp, stretches in edges.items()}
    near = []
    for imp, r in found.where("_kind = 1").select("imp", "_r").distinct().collect():
        lo, hi = np.searchsorted([x[0] for x in every.get(imp, [])], [r << STRETCH, (r + 1) << STRETCH])
        near.append((imp, r, every.get(imp, [])[max(0, lo - donors) : lo] + every.get(imp, [])[hi : hi + donors]))
    entry = "array<struct<at:long,p:double,v:double>>"
    sides = spark.createDataFrame(near, f"imp int, _r int, _e {entry}")
    waits = found.where("_kind = 1").join(F.broadcast(sides), ["imp", "_r"], "left").withColumn("_c", F.array_sort(F.concat("_c", F.coalesce("_e", F.array().cast(entry)))))
    before = F.filter("_c", lambda x: x["at"] < F.col("_at"))
    after = F.filter("_c", lambda x: x["at"] > F.col("_at"))
    both = F.concat(F.slice(before, F.greatest(F.lit(1), F.size(before) - (donors - 1)), donors), F.slice(after, 1, donors))
    apart = F.transform(both, lambda x: F.struct(F.abs(x["p"] - F.col("_p")).alias("d"), x["at"], x["v"]))
    waits = waits.select("imp", "_k", apart.alias("_c")).groupBy("imp", "_k").agg(F.slice(F.array_sort(F.flatten(F.collect_list("_c"))), 1, donors).alias("_c"))
    late = waits.select("imp", "_k", F.get("_c", F.floor(F.col("_k._u") * F.size("_c")).cast("int"))["v"].alias("_new"))
    drawn = found.where("_kind = 0").select("imp", "_k", "_new").unionByName(late)
    return drawn.select("imp", *[F.col(f"_k.{k}").alias(k) for k in keys], "_new"), held


#: Bits of a row's number within its stretch of the order.
STRETCH = 40
#: Rows of a stretch, rows that a task gathers before it deals them out, and rows that show where to part the order.
STRETCH_ROWS, BLOCK_ROWS, SAMPLE = 1_000_000, 1_000_000, 50_000


def _bounds(some: pd.DataFrame, c: str, others: list[str], models: dict, stretches: int, seed: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chain the (prediction, missing, hash) that part its order into ``stretches``: even shares of some rows."""
    na, x = some[f"_na_{c}"].to_numpy(bool), [some[o].to_numpy(float) for o in others]
    h = np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, len(some), dtype=np.int64)
    out = {}
    for imp, (b, d) in models.items():
        p = np.where(na, _predicted(d, x), _predicted(b, x))
        order = np.lexsort((h, na, p))[np.arange(1, stretches) * len(p) // stretches] if len(p) else np.zeros(0, int)
        out[imp] = p[order], na[order], h[order]
    return out


def _predicted(b: Sequence[float], x: Sequence[np.ndarray]) -> np.ndarray:
    """``linear_score`` of columns."""
    out = np.full(len(x[0]) if x else 1, float(b[0]))
    for k, v in enumerate(x):
        out += float(b[k + 1]) * v
    return out


def _place(bounds: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray, na: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Stretch of each row; equal predictions are parted by the other two."""
    at = np.searchsorted(bounds[0], p, side="left")
    tied = np.flatnonzero(np.searchsorted(bounds[0], p, side="right") > at)
    for bp, bna, bh in zip(*bounds, strict=True) if len(tied) else ():
        same = tied[(p[tied] == bp) | (np.isnan(p[tied]) & np.isnan(bp))]
        at[same] += (na[same] > bna) | ((na[same] == bna) & (h[same] >= bh))
    return at


def _packed(r: np.ndarray, p: np.ndarray, h: np.ndarray, v: np.ndarray) -> tuple[list[int], list[bytes]]:
    """The numbers of the rows of each stretch in one piece."""
    order = np.argsort(r, kind="stable")
    numbers, first = np.unique(r[order], return_index=True)
    return numbers.tolist(), [p[at].tobytes() + h[at].tobytes() + v[at].tobytes() for at in np.split(order, first[1:])]


def _dealt(whole: DataFrame, own: DataFrame, others: list[str], models: dict, bounds: dict, stretches: int) -> DataFrame:
    """``_r, _p, _h, _k, _b``: blocks ``_b`` of observed rows and single missing rows, the rows of stretch ``_r`` together.

    ``whole`` (predictors, _h, _v) are the rows that every chain has; ``own`` (imp, predictors, _na, _h, _v, _k) those of a chain.
    """
    first = {imp: i * stretches for i, imp in enumerate(sorted(models))}
    key = own.schema["_k"].dataType
    numbers = lambda column: column.to_numpy(zero_copy_only=False).astype(float, copy=False)

    def every_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            *x, h, v = (np.concatenate(c) for c in zip(*held, strict=True))
            for imp, (b, _) in models.items():
                p = np.broadcast_to(_predicted(b, x), len(h))
                r, packed = _packed(first[imp] + _place(bounds[imp], p, np.zeros(len(h), bool), h), p, h, v)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.array(packed, pa.binary())], ["_r", "_b"])

        held, size = [], 0
        for batch in batches:
            held.append((*(numbers(c) for c in batch.columns[:-2]), np.asarray(batch.column("_h")), numbers(batch.column("_v"))))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield from blocks(held)
                held, size = [], 0
        if size:
            yield from blocks(held)

    def one_chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_r", "_p", "_h", "_k", "_b"]

        def blocks(held: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            r, packed = _packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(r, pa.int32()), pa.nulls(len(r), pa.float64()), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), kind), pa.array(packed, pa.binary())], names)

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            imp, h, v, x = np.asarray(batch.column("imp")), np.asarray(batch.column("_h")), numbers(batch.column("_v")), [numbers(batch.column(o)) for o in others]
            na, kind = batch.column("_na").to_numpy(zero_copy_only=False), batch.column("_k").type
            p, r = np.zeros(len(imp)), np.zeros(len(imp), dtype=int)
            for i in np.unique(imp).tolist():
                at = np.flatnonzero(imp == i)
                p[at] = np.where(na[at], *(_predicted(b, [o[at] for o in x]) for b in reversed(models[i])))
                r[at] = first[i] + _place(bounds[i], p[at], na[at], h[at])
            gone = np.flatnonzero(na)
            if len(gone):
                yield pa.RecordBatch.from_arrays([pa.array(r[gone].astype("int32")), pa.array(p[gone]), pa.array(h[gone]), batch.column("_k").take(pa.array(gone)), pa.nulls(len(gone), pa.binary())], names)
            held.append((r[~na], p[~na], h[~na], v[~na]))
            size += batch.num_rows - len(gone)
            if size >= BLOCK_ROWS:
                yield blocks(held, kind)
                held, size = [], 0
        if size:
            yield blocks(held, kind)

    none = F.lit(None)
    pool = whole.mapInArrow(every_chain, "_r int, _b binary").select("_r", none.cast("double").alias("_p"), none.cast("long").alias("_h"), none.cast(key).alias("_k"), "_b")
    own_schema = T.StructType([T.StructField("_r", T.IntegerType()), T.StructField("_p", T.DoubleType()), T.StructField("_h", T.LongType()), T.StructField("_k", key), T.StructField("_b", T.BinaryType())])
    parts = max(1, stretches * len(models))
    return own.mapInArrow(one_chain, own_schema).unionByName(pool).repartitionById(parts, "_r")


def _in_order(batches: Iterator[pa.RecordBatch], chains: Sequence[int], stretches: int) -> Iterator[pa.RecordBatch]:
    """The rows (imp, _p, _na, _v, _k, _r) of a stretch in order of prediction, missing and hash, from its blocks and missing rows."""
    p, h, v, gone, r = [], [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        r, kind = batch.column("_r")[0].as_py(), batch.column("_k").type
        for block in batch.column("_b").drop_null():
            x = np.frombuffer(block.as_buffer(), dtype=float).reshape(3, -1)
            p.append(x[0])
            h.append(x[1].view(np.int64))
            v.append(x[2])
        single = batch.filter(batch.column("_b").is_null())
        if single.num_rows:
            gone.append((np.asarray(single.column("_p")), np.asarray(single.column("_h")), single.column("_k")))
    if r is None:
        return
    seen = sum(map(len, p))
    p, h = (np.concatenate([*x, *(g[i] for g in gone)]) for i, x in enumerate((p, h)))
    na = np.arange(len(p)) >= seen
    v = np.concatenate([*v, np.full(len(p) - seen, np.nan)])
    order = np.argsort(p, kind="stable")
    same = p[order[1:]] == p[order[:-1]]
    tied = np.flatnonzero(np.append(same, False) | np.insert(same, 0, False))
    order[tied] = order[tied][np.lexsort((h[order[tied]], na[order[tied]], p[order[tied]]))]
    keys = pa.concat_arrays([g[2] for g in gone]) if gone else pa.nulls(0, kind)
    spot = pa.array(order - seen, pa.int64(), mask=~na[order])
    n = len(order)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, chains[r // stretches], "int32")), pa.array(p[order]), pa.array(na[order]), pa.array(v[order]), keys.take(spot), pa.array(np.full(n, r, "int32"))],
        ["imp", "_p", "_na", "_v", "_k", "_r"],
    )


def _donors(placed: DataFrame, donors: int, chains: Sequence[int] = (), stretches: int = 0) -> DataFrame:
    """Donors of the missing rows in every partition of ``placed`` (imp, _p, _na, _v, _k, _r), which is a stretch of the order.

    With ``stretches`` for each of the ``chains``, ``placed`` is what ``_dealt`` gives, and is put in order here.

    Rows of ``_kind`` 0 are missing rows with their drawn value ``_new``; of kind 1 those that have too few observed rows
    before or after them in the stretch, or share their key with others, with the observed rows around them; of kind 2 the
    first and last observed rows of a chain in the stretch. A task keeps the rows from the first undecided one on.
    """
    none = T.ArrayType(T.StructType([T.StructField("at", T.LongType()), T.StructField("p", T.DoubleType()), T.StructField("v", T.DoubleType())]))
    schema = T.StructType([
        T.StructField("_kind", T.IntegerType()), T.StructField("imp", T.IntegerType()), T.StructField("_r", T.IntegerType()), T.StructField("_at", T.LongType()),
        T.StructField("_p", T.DoubleType()), T.StructField("_k", placed.schema["_k"].dataType), T.StructField("_new", T.DoubleType()), T.StructField("_c", none),
    ])
    entries = pa.list_(pa.struct([("at", pa.int64()), ("p", pa.float64()), ("v", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key_type: list = []

        def lists(where: list[np.ndarray], at, p, v) -> pa.Array:
            flat = np.concatenate(where) if where else np.zeros(0, int)
            ends = np.concatenate([[0], np.cumsum([len(w) for w in where])]).astype("int32")
            return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(at[flat]), pa.array(p[flat]), pa.array(v[flat])], ["at", "p", "v"])).cast(entries)

        def out(kind: int, imp: int, r: int, at, p, k: pa.Array, new, c: pa.Array) -> pa.RecordBatch:
            n = len(at)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, "int32")), pa.array(np.full(n, imp, "int32")), pa.array(np.full(n, r, "int32")), pa.array(at), pa.array(p), k, new, c], [f.name for f in schema.fields])

        def settle(imp: int, r: int, rows: tuple, first: int, last: bool) -> tuple[list[pa.RecordBatch], tuple]:
            """Decides the missing rows from ``first`` on that have their donors after them, or all rows of a chain that ends here; keeps the rest."""
            p, na, v, at, k = rows
            seen = np.flatnonzero(~na)
            gone = np.flatnonzero(na)
            gone = gone[gone >= first]
            left = np.searchsorted(seen, gone)
            ready = np.ones(len(gone), bool) if last else len(seen) - left >= donors
            stop = len(na) if ready.all() else int(gone[~ready][0])
            gone, left = gone[ready], left[ready]
            done = []
            if len(gone):
                struct = k.take(pa.array(gone))
                easy = (left >= donors) & (len(seen) - left >= donors) & ~np.asarray(struct.field("_twice").is_valid())
                if easy.any():
                    spot = seen[left[easy, None] + np.arange(-donors, donors)]
                    d = np.abs(p[spot] - p[gone[easy], None])
                    spot = np.take_along_axis(spot, np.argsort(d, axis=1, kind="stable")[:, :donors], axis=1)
                    u = np.asarray(struct.field("_u"))[easy]
                    new = v[spot[np.arange(len(spot)), np.floor(u * donors).astype(int)]]
                    done.append(out(0, imp, r, at[gone[easy]], p[gone[easy]], struct.filter(pa.array(easy)), pa.array(new), pa.nulls(len(new), entries)))
                if not easy.all():
                    hard = ~easy
                    around = [seen[max(0, a - donors) : a + donors] for a in left[hard]]
                    done.append(out(1, imp, r, at[gone[hard]], p[gone[hard]], struct.filter(pa.array(hard)), pa.nulls(int(hard.sum()), pa.float64()), lists(around, at, p, v)))
            keep = min(stop, len(na))
            back = seen[seen < keep][-donors:]
            start = int(back[0]) if len(back) else keep
            start = min(start, keep)
            return done, (tuple(x[start:] for x in rows[:4]) + (k.slice(start),), keep - start)

        now, held, first, head, tail, r, number = None, None, 0, [], [], 0, 0

        def edge() -> list[pa.RecordBatch]:
            ends = sorted({*head, *tail})
            if not ends:
                return []
            at, p, v = (np.array(x) for x in zip(*ends))
            return [out(2, now, r, np.zeros(1, "int64"), np.zeros(1), pa.nulls(1, key_type[0]), pa.nulls(1, pa.float64()), lists([np.arange(len(ends))], at.astype("int64"), p.astype(float), v.astype(float)))]

        for batch in _in_order(batches, chains, stretches) if stretches else batches:
            if not batch.num_rows:
                continue
            key_type[:] = [batch.column(4).type]
            imps, r = np.asarray(batch.column(0)), batch.column(5)[0].as_py()
            at = (np.int64(r) << STRETCH) + number + np.arange(batch.num_rows, dtype="int64")
            number += batch.num_rows
            p, na, v = np.asarray(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy(zero_copy_only=False).astype(float)
            cuts = [0, *(np.flatnonzero(np.diff(imps)) + 1), len(imps)]
            for a, b in zip(cuts, cuts[1:]):
                imp = int(imps[a])
                if imp != now:
                    if held is not None:
                        done, _ = settle(now, r, held, first, True)
                        yield from done
                        yield from edge()
                    now, held, first, head, tail = imp, None, 0, [], []
                part = (p[a:b], na[a:b], v[a:b], at[a:b], batch.column(4).slice(a, b - a))
                seen = np.flatnonzero(~part[1])
                row = lambda i: (int(part[3][i]), float(part[0][i]), float(part[2][i]))  # noqa: E731, B023
                head += [row(i) for i in seen[: donors - len(head)]]
                tail = [*tail, *[row(i) for i in seen[-donors:]]][-donors:]
                if held is not None:
                    part = tuple(np.concatenate([x, y]) for x, y in zip(held[:4], part[:4])) + (pa.concat_arrays([held[4], part[4]]),)
                done, (held, first) = settle(now, r, part, first, False)
                yield from done
        if held is not None:
            done, _ = settle(now, r, held, first, True)
            yield from done
            yield from edge()

    return placed.mapInArrow(run, schema)


def average_imputations(stacked: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Element-wise mean of the completed tables."""
    return stacked.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in cols])
