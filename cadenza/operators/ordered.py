"""Order and running sums in which no group is one task.

A window that numbers or sums the rows of a group is one task for each group,
and a group may hold a third of all rows. Here rows are dealt out by ranges of
(group, order), so that a large group lies in many partitions: sums run inside
the part of a group that one partition holds, and the parts' own totals, a row
for each group and partition, are summed apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.sources.stored import written

#: Bits of an id that count the rows of a partition; a fixed value of Spark's.
_ROW_BITS = 33


def ordered(df: DataFrame, order: Sequence[Column | str], what: str = "ordered") -> DataFrame:
    """df in the order of these columns, as a table in the shared folder, with
    `_part`, the number of a range of the order, and `_at`, the row's place in
    it; (_part, _at) sorts as the order does. Nulls come first. Rows that are
    equal in all of them are told apart by where they were read, so that many
    equal rows are dealt out too."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*order, "_read"]
    rows = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_read")
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), what)
    return rows.withColumns({"_part": F.shiftright("_id", _ROW_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))}).drop("_id")


def running(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], sums: Mapping[str, Column | str], xors: Mapping[str, Column | str] | None = None, what: str = "running") -> DataFrame:
    """df with a running sum for each name of `sums`, and a running exclusive or
    for each of `xors`: of that column, bigint or double, over the rows of the
    same group up to and with this one, by `order`, which should be total.
    Groups may be null. No groups: over the whole table.

    Rows move once. In a sorted range only the first group can have begun
    before, so one row for each range, the driver's share, says what it had by
    then. Overflow raises."""
    values = {**sums, **(xors or {})}
    df = df.withColumns({f"_v_{k}": F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)) for k, v in values.items()}).withColumn("_g", F.xxhash64(*groups) if groups else F.lit(0).cast("bigint"))
    df = df.withColumns({f"_v_{k}": F.col(f"_v_{k}").cast("bigint") for k in values if df.schema[f"_v_{k}"].dataType != T.DoubleType()})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*groups, *order, "_read"]
    rows = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(n, *by).sortWithinPartitions(*by).drop("_read")
    kinds = {k: rows.schema[f"_v_{k}"].dataType.simpleString() for k in values}
    plain = [c for c in rows.columns if c != "_g" and c not in {f"_v_{k}" for k in values}]

    names, added, zero = list(values), set(sums), {k: 0.0 if t == "double" else 0 for k, t in kinds.items()}

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        passed = False
        carry = dict(zero)
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column("_g").to_numpy()
            first = int(g[0]) if first is None else first
            bounds = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1])
            size = np.diff(np.append(bounds, len(g)))
            found = []
            for k in names:
                v = batch.column(f"_v_{k}").to_numpy()
                inside = carry[k] if int(g[0]) == last else 0
                if k in added:
                    total = np.cumsum(v)
                    if v.dtype.kind == "i" and float(np.abs(v.astype(float)).sum()) + abs(inside) >= 2.0**63:
                        raise OverflowError(f"the sum {k} does not fit 64 bits")
                    before = np.where(bounds > 0, total[bounds - 1], 0)
                    total = total - np.repeat(before, size)
                    total[: size[0]] += inside
                else:
                    total = np.bitwise_xor.accumulate(v)
                    before = np.where(bounds > 0, total[bounds - 1], 0)
                    total = total ^ np.repeat(before, size)
                    total[: size[0]] ^= inside
                carry[k] = total[-1].item()
                found.append(pa.array(total))
            last = int(g[-1])
            # The range's first group, until another one begins.
            other = g != first
            head = np.zeros(len(g), dtype=bool) if passed else ~np.maximum.accumulate(other)
            passed = passed or bool(other.any())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(g), pa.array(head), *found], names=[*plain, "_g", "_head", *names])

    schema = T.StructType([*(rows.schema[c] for c in plain), T.StructField("_g", T.LongType()), T.StructField("_head", T.BooleanType()), *(T.StructField(k, rows.schema[f"_v_{k}"].dataType) for k in values)])
    at = F.monotonically_increasing_id()
    rows = rows.mapInArrow(sum_up, schema).withColumn("_id", at)
    rows = written(rows, what).withColumn("_part", F.shiftright("_id", _ROW_BITS))
    ends = rows.groupBy("_part").agg(F.min_by("_g", "_id").alias("first"), F.max_by(F.struct("_g", *values), "_id").alias("last")).sort("_part").collect()
    carries, open_, held = [], None, zero
    for r in ends:
        held = held if r["first"] == open_ else zero
        carries.append((r["_part"], *held.values()))
        whole = r["first"] == r["last"]["_g"]
        held = {k: (held[k] + r["last"][k] if k in sums else held[k] ^ r["last"][k]) if whole else r["last"][k] for k in values}
        open_ = r["last"]["_g"]
        if big := [k for k, v in held.items() if isinstance(v, int) and not -(1 << 63) <= v < 1 << 63]:
            raise OverflowError(f"the sum {big[0]} does not fit 64 bits")
    earlier = df.sparkSession.createDataFrame(carries, ", ".join(["_part bigint", *(f"`_c_{k}` {t}" for k, t in kinds.items())]))
    here = {k: F.when(F.col("_head"), F.col(f"_c_{k}")).otherwise(F.lit(0).cast(t)) for k, t in kinds.items()}
    both = [(F.col(k) + here[k] if k in sums else F.col(k).bitwiseXOR(here[k])).alias(k) for k in values]
    # As many rows as there are ranges.
    return rows.join(F.broadcast(earlier), "_part").select(*plain, *both)


def summed(rows: DataFrame, groups: Sequence[str], part: str, order: Sequence[Column | str], sums: Mapping[str, str], xors: Mapping[str, str] | None = None) -> DataFrame:
    """rows with running sums by (part, order) in each group, where `part` cuts
    a group into parts that fit a task. xors: as sums, of exclusive or."""
    kinds = {k: (v, F.sum) for k, v in sums.items()} | {k: (v, F.bit_xor) for k, v in (xors or {}).items()}
    within = Window.partitionBy(*groups, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*groups, part).agg(*[f(v).alias(f"_t_{k}") for k, (v, f) in kinds.items()])
    before = Window.partitionBy(*groups).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*groups, part, *[F.coalesce(f(f"_t_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k, (_, f) in kinds.items()])
    inside = rows.withColumns({f"_w_{k}": f(v).over(within) for k, (v, f) in kinds.items()})
    same = F.col(f"r.{part}") == F.col(f"t.{part}")
    for g in groups:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    both = {k: F.col(f"_b_{k}") + F.col(f"_w_{k}") if f is F.sum else F.col(f"_b_{k}").bitwiseXOR(F.col(f"_w_{k}")) for k, (_, f) in kinds.items()}
    return inside.alias("r").join(totals.alias("t"), same).select(*[f"r.{c}" for c in rows.columns], *[v.alias(k) for k, v in both.items()])


def numbered(df: DataFrame, groups: Sequence[str], order: Sequence[Column | str], out: str = "number", what: str = "numbered") -> DataFrame:
    """df with `out`, 1, 2, ... by `order` in each group; rows that are equal
    in the order get their numbers in any order."""
    return running(df, groups, order, {out: F.lit(1).cast("bigint")}, what=what)


def followed(rows: DataFrame, groups: Sequence[str], part: str, order: Sequence[str], nexts: Mapping[str, str]) -> DataFrame:
    """rows with the next row's values, by (part, order) in each group: nexts
    names them. Null behind a group's last row. As `summed`, no window spans
    more than a part of a group."""
    within = Window.partitionBy(*groups, part).orderBy(*order)
    first = F.min_by(F.struct(*[F.col(v).alias(f"_n_{k}") for k, v in nexts.items()]), F.struct(*order))
    firsts = rows.groupBy(*groups, part).agg(first.alias("_f"))
    after = firsts.select(*groups, part, F.lead("_f").over(Window.partitionBy(*groups).orderBy(part)).alias("_f"))
    inside = rows.withColumn("_w", F.lead(F.struct(*[F.col(v).alias(f"_n_{k}") for k, v in nexts.items()])).over(within))
    same = F.col(f"r.{part}") == F.col(f"t.{part}")
    for g in groups:
        same &= F.col(f"r.{g}").eqNullSafe(F.col(f"t.{g}"))
    following = F.coalesce("r._w", "t._f")
    return inside.alias("r").join(after.alias("t"), same).select(*[f"r.{c}" for c in rows.columns], *[following[f"_n_{k}"].alias(k) for k in nexts])
