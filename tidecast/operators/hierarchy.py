"""The hierarchy of planning nodes: oem x region x product, with ``ALL`` for a dimension that is summed over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidecast.config import ALL

DIMS = ("oem", "region", "product")
#: Levels and the dimensions that their nodes name.
LEVELS = {"TOTAL": (), "REGION": ("region",), "OEM": ("oem",), "PRODUCT": ("product",), "OEM_REGION": ("oem", "region"), "BOTTOM": DIMS}
#: Levels from coarse to fine; overrides of finer levels bind first.
DEPTH = {"TOTAL": 0, "REGION": 1, "OEM": 1, "PRODUCT": 1, "OEM_REGION": 2, "BOTTOM": 3}


def level_of(oem: Column, region: Column, product: Column) -> Column:
    named = {"oem": oem != ALL, "region": region != ALL, "product": product != ALL}
    out = F.lit("INVALID")
    for level, dims in LEVELS.items():
        fits = F.lit(True)
        for d in DIMS:
            fits = fits & (named[d] if d in dims else ~named[d])
        out = F.when(fits, level).otherwise(out)
    return out


def depth_of(level: Column) -> Column:
    out = F.lit(0)
    for name, depth in DEPTH.items():
        out = F.when(level == name, depth).otherwise(out)
    return out


def node_id(*dims: Column) -> Column:
    return F.concat_ws("|", *dims)


def parse_node(node: Column) -> list[Column]:
    parts = F.split(node, r"\|")
    return [parts[i].alias(d) for i, d in enumerate(DIMS)]


def matches(node: list[Column], leaf: list[Column]) -> Column:
    """Whether a leaf lies under a node."""
    out = F.lit(True)
    for n, x in zip(node, leaf, strict=True):
        out = out & ((n == ALL) | (n == x))
    return out


def overlaps(a: list[Column], b: list[Column]) -> Column:
    """Whether two nodes have leaves in common."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & ((x == y) | (x == ALL) | (y == ALL))
    return out


def at_node(df: DataFrame, oem: str = ALL, region: str = ALL, product: str = ALL) -> DataFrame:
    for d, v in zip(DIMS, (oem, region, product), strict=True):
        if v != ALL:
            df = df.filter(F.col(d) == v)
    return df


def rollup(df: DataFrame, values: dict[str, Column], keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """Leaf rows summed to all six levels in one aggregation: level, oem, region, product, keys and values (aggregate columns by name).

    Levels are told by the grouping, so a null in a dimension is a group of its own."""
    sets = [[*(F.col(d) for d in dims), *(F.col(k) for k in keys)] for dims in LEVELS.values()]
    summed = df.groupingSets(sets, *(F.col(c) for c in (*DIMS, *keys))).agg(
        *(F.grouping(d).alias(f"_{d}") for d in DIMS), *(v.alias(name) for name, v in values.items())
    )
    level = F.lit("INVALID")
    for name, dims in LEVELS.items():
        fits = F.lit(True)
        for d in DIMS:
            fits = fits & (F.col(f"_{d}") == (0 if d in dims else 1))
        level = F.when(fits, name).otherwise(level)
    labelled = [F.when(F.col(f"_{d}") == 1, ALL).otherwise(F.col(d)).alias(d) for d in DIMS]
    return summed.select(level.alias("level"), *labelled, *keys, *values)


def edges(leaves: DataFrame) -> DataFrame:
    """(node, leaf) for each leaf and each of the six nodes above it: the summing matrix as rows."""
    nodes = F.array(*(node_id(*(F.col(d) if d in dims else F.lit(ALL) for d in DIMS)) for dims in LEVELS.values()))
    return leaves.select(*DIMS).distinct().select(F.explode(nodes).alias("node"), node_id(*(F.col(d) for d in DIMS)).alias("leaf"))


def coherence_error(nodes: DataFrame, value: str, keys: tuple[str, ...] = ("month",)) -> DataFrame:
    """One row: the greatest difference between a node's value and the sum of its leaves'."""
    leaves = nodes.filter(F.col("level") == "BOTTOM")
    summed = rollup(leaves, {"_sum": F.sum(value)}, keys)
    return nodes.join(summed, ["level", *DIMS, *keys]).agg(F.max(F.abs(F.col(value) - F.col("_sum"))).alias("error"))
