"""Deletes that follow foreign keys, and the switch between active rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import REFERENCES


def order() -> list[str]:
    """Tables so that each comes after those that it refers to."""
    out: list[str] = []
    todo = sorted({t for t, *_ in REFERENCES} | {parent for _, _, parent, _, _ in REFERENCES})
    while todo:
        free = [t for t in todo if all(parent in out or parent == t for child, _, parent, _, _ in REFERENCES if child == t)]
        if not free:
            raise ValueError(f"the references of {todo} run in a circle")
        out += free
        todo = [t for t in todo if t not in free]
    return out


def delete(tables: dict[str, DataFrame], name: str, gone: Column) -> dict[str, DataFrame]:
    """The tables without the rows of `name` for which `gone` holds, and what hangs on those rows: a table that refers to them
    loses its rows (cascade) or its reference (set null), and so on down.

    One anti or left join for each reference that is touched, on distinct keys; a null reference hangs on nothing, and a
    row whose `gone` is null stays. Tables that are not given are left out; keys may hold any share of a child's rows, as
    the side of the keys holds each once.
    """
    out = dict(tables)
    gone = F.coalesce(gone, F.lit(False))
    lost = {name: tables[name].filter(gone)}
    out[name] = tables[name].filter(~gone)
    for child in order():
        for table, column, parent, key, rule in REFERENCES:
            if table != child or parent not in lost or child not in tables:
                continue
            keys = lost[parent].select(F.col(key).alias(column)).filter(F.col(column).isNotNull()).distinct()
            if rule == "cascade":
                more = out[child].join(keys, column, "left_semi").select(*out[child].columns)
                lost[child] = lost[child].unionByName(more) if child in lost else more
                out[child] = out[child].join(keys, column, "left_anti").select(*tables[child].columns)
            else:
                kept = out[child].join(keys.withColumn("_gone", F.lit(True)), column, "left")
                out[child] = kept.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).select(*tables[child].columns)
    return out


def orphans(tables: dict[str, DataFrame]) -> DataFrame | None:
    """table, column, n: rows that refer to a row that is not there, for each reference between the given tables."""
    found = None
    for child, column, parent, key, _ in REFERENCES:
        if child in tables and parent in tables:
            keys = tables[parent].select(F.col(key).alias(column)).distinct()
            n = tables[child].filter(F.col(column).isNotNull()).join(keys, column, "left_anti").agg(F.count("*").alias("n"))
            n = n.select(F.lit(child).alias("table"), F.lit(column).alias("column"), "n")
            found = n if found is None else found.unionByName(n)
    return found


def activate(rows: DataFrame, keep: DataFrame, key: str, group: str, active: str = "is_active", at: str = "updated_at", now: Column | None = None) -> DataFrame:
    """rows after one row of each group in `keep` (group, key) is switched on and the group's others off.

    Only rows that change get a new stamp; a group without a row to keep stays as it is, and so does one whose row to
    keep does not exist, so that no group is left without an active row.
    """
    now = F.current_timestamp() if now is None else now
    real = keep.groupBy(group).agg(F.min(key).alias("_keep")).join(rows.select(group, F.col(key).alias("_keep")), [group, "_keep"], "left_semi")
    both = rows.join(real, group, "left")
    wanted = F.when(F.col("_keep").isNull(), F.col(active)).otherwise(F.col(key) == F.col("_keep"))
    both = both.withColumn("_new", wanted).withColumn(at, F.when(F.col("_new").eqNullSafe(F.col(active)), F.col(at)).otherwise(now))
    return both.withColumn(active, F.col("_new")).select(*rows.columns)
