"""Data contracts: declared expectations on a table, checked in one pass, reported as rows or raised."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A table doesn't keep what is declared of it."""


@dataclass(frozen=True)
class Contract:
    """What must hold of a table; everything but cell counts is checked in a single aggregate."""

    columns: Sequence[str] = ()
    rows: int | None = None
    unique: Sequence[str] = ()
    not_null: Sequence[str] = ()
    permutation: str | None = None
    finite: Sequence[str] = ()
    #: grouping columns and the count that every group must have
    cells: tuple[Sequence[str], int] | None = None
    values: dict[str, Sequence] = field(default_factory=dict)


def violations(df: DataFrame, contract: Contract) -> list[str]:
    missing = [c for c in contract.columns if c not in df.columns]
    if missing:
        return [f"columns {missing} are missing"]
    checks: dict[str, Column] = {"n": F.count("*")}
    if contract.unique:
        checks["n_unique"] = F.count_distinct(F.struct(*contract.unique))
    for c in contract.not_null:
        checks[f"null:{c}"] = F.count_if(F.col(c).isNull())
    if p := contract.permutation:
        checks |= {"p_lo": F.min(p), "p_hi": F.max(p), "p_n": F.count_distinct(p)}
    for c in contract.finite:
        checks[f"finite:{c}"] = F.count_if(F.exists(F.col(c), lambda x: F.isnan(x) | (F.abs(x) == float("inf"))))
    for c, allowed in contract.values.items():
        checks[f"value:{c}"] = F.count_if(~F.col(c).isin(*allowed))
    r = df.agg(*[v.alias(k) for k, v in checks.items()]).first().asDict()
    found = []
    if contract.rows is not None and r["n"] != contract.rows:
        found.append(f"{r['n']} rows, not {contract.rows}")
    if contract.unique and r["n_unique"] != r["n"]:
        found.append(f"{list(contract.unique)} repeat")
    if contract.permutation and r["n"] and (r["p_lo"], r["p_hi"], r["p_n"]) != (1, r["n"], r["n"]):
        found.append(f"{contract.permutation} isn't a permutation of 1..{r['n']}")
    found += [f"{k} fails for {v} rows" for k, v in r.items() if ":" in k and v]
    if contract.cells:
        keys, n = contract.cells
        if bad := df.groupBy(*keys).count().where(F.col("count") != n).limit(5).collect():
            found.append(f"cells without {n} rows: {[tuple(b) for b in bad]}")
    return found


def enforced(df: DataFrame, contract: Contract) -> DataFrame:
    """``df`` itself if it keeps the contract; else an error that names all that it doesn't keep."""
    if found := violations(df, contract):
        raise ContractError("; ".join(found))
    return df


def same_within(a: DataFrame, b: DataFrame, key: Sequence[str], columns: Sequence[str], atol: float = 1e-12, rtol: float = 0.0) -> DataFrame:
    """Keys whose values differ (nulls and NaN are equal to each other), or that one side lacks."""
    x, y = a.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_a")), b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_b"))

    def differs(c):
        p, q = F.col(f"_a_{c}").cast("double"), F.col(f"_b_{c}").cast("double")
        none_p, none_q = p.isNull() | F.isnan(p), q.isNull() | F.isnan(q)
        return F.when(none_p | none_q, none_p != none_q).otherwise(F.abs(p - q) > atol + rtol * F.abs(q))

    bad = F.col("_a").isNull() | F.col("_b").isNull()
    for c in columns:
        bad = bad | differs(c)
    return x.join(y, list(key), "full_outer").where(bad).select(*key)


def gate_status(overlaps: Column, undefined: Column) -> Column:
    """The advisory gate: any overlap of splits or undefined AUROC asks for a review."""
    return F.when((overlaps == 0) & (undefined == 0), "GO").otherwise("REVIEW REQUIRED")


def missing_cells(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    return expected.join(observed.select(*keys).distinct(), list(keys), "left_anti")
