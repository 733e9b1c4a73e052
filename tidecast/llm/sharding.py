"""Operator 8 [native]: sharding in the order of a Hilbert curve over quantised metadata.

Each row gets a cell of a grid of ``2**BITS`` steps a side from its metadata: source and language (hashed), size (its
number of binary digits) and doc_id (between quantiles, so steps hold about as many rows). Cells are ordered by their index on the Hilbert curve, rows within a
cell by doc_id, text hash and size, and the ordering is cut into runs: files then cover small boxes of the grid, so that
readers with filters on any of the four can skip most of them. Law ``rows``: a shard has the rows of ranks
ceil(s*n/k) to ceil((s+1)*n/k)-1, so counts are at most one apart.

DataFrame functions alone. Texts are read once, for a table of measures in the shared folder, which the result reads. Rows are dealt to ranges of the whole order (cell, doc_id, hash, size) that begin at keys picked by their hash, so that a cell of any size is cut. The rank of a row is the count of
rows in the ranges before its own (a table of one number a range, broadcast) plus its number within the range; only (range, cell, id, size, hash) is shuffled. The table of cells has at most 65,536 rows.
Nulls: a null text has size 16 and hash 0; null sources and languages have a step of their own, null ids come first.
Repeated rows each have their own slot; rows with one id, hash and size are ties in no order and stay in one range; very long texts are rows like others.
Empty tables give empty tables. Further columns of the input are not kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch, range_of, range_starts

SHARDS = 40
BITS = 4
OVERHEAD = 16
#: Rows of a range, about; keys that are picked for a range; keys at most (they are a constant of the plan).
RANGE_ROWS, FINE, PICKED = 5000, 4, 1 << 18


def hilbert_index(df: DataFrame, dims: list[str], bits: int, name: str) -> DataFrame:
    """Adds the index along the Hilbert curve of points with the integer coordinates ``dims`` below ``2**bits``.

    The axes are turned and flipped from the highest bit down, then Gray-coded, and the bits are interleaved."""
    x = [f"_x{i}" for i in range(len(dims))]
    df = df.withColumns({a: F.col(d).cast("int") for a, d in zip(x, dims, strict=True)})

    def put(new: dict[str, Column]) -> None:
        nonlocal df
        df = df.withColumns(new)

    for q in (1 << b for b in range(bits - 1, 0, -1)):
        p = F.lit(q - 1)
        for i, a in enumerate(x):
            on = F.col(a).bitwiseAND(q) != 0
            if i == 0:
                put({a: F.when(on, F.col(a).bitwiseXOR(p)).otherwise(F.col(a))})
                continue
            t = F.col(x[0]).bitwiseXOR(F.col(a)).bitwiseAND(p)
            put({"_t": F.when(on, p).otherwise(t), "_u": F.when(on, 0).otherwise(t)})
            put({x[0]: F.col(x[0]).bitwiseXOR(F.col("_t")), a: F.col(a).bitwiseXOR(F.col("_u"))})
    for a, b in zip(x, x[1:], strict=False):
        put({b: F.col(b).bitwiseXOR(F.col(a))})
    t = F.lit(0)
    for q in (1 << b for b in range(bits - 1, 0, -1)):
        t = t.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(q) != 0, q - 1).otherwise(0))
    put({"_t": t})
    index = F.lit(0)
    for b in range(bits - 1, -1, -1):
        for a in x:
            index = index * 2 + F.shiftright(F.col(a).bitwiseXOR(F.col("_t")), b).bitwiseAND(1)
    return df.withColumn(name, index.cast("int")).drop(*x, "_t", "_u")


def measures(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    step = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % (1 << BITS) + 0, F.lit(0)).cast("int")
    out = docs.select(
        "doc_id", (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), step("source").alias("d_source"), step("lang").alias("d_lang")
    )
    return out.withColumn("d_size", F.least(F.greatest(F.length(F.bin("size")) - 5, F.lit(0)), F.lit((1 << BITS) - 1)).cast("int"))


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and key: the place of each row in the whole order."""
    steps = 1 << BITS
    dims = ["d_source", "d_lang", "d_size", "d_id"]
    cuts = docs.agg(F.percentile_approx("doc_id", [k / steps for k in range(1, steps)], 10_000)).first()[0] or []
    rows = Scratch(docs.sparkSession, "sharding").save(measures(docs), "measures").withColumn("d_id", F.coalesce(sum((F.when(F.col("doc_id") > c, 1).otherwise(0) for c in cuts), F.lit(0)), F.lit(0)))
    cells = hilbert_index(rows.select(*dims).distinct(), dims, BITS, "hilbert")  # at most 2**(4*BITS) rows
    key = F.struct("hilbert", F.col("doc_id").isNotNull().cast("int").alias("some"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "text_crc32", "size")
    return rows.join(F.broadcast(cells), dims).select("doc_id", "size", "text_crc32", key.alias("key"))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law) and the curve index."""
    rows = placed(docs)
    rows = rows.withColumn("range", range_of("key", rows.schema["key"].dataType, range_starts(rows.select("key"), RANGE_ROWS, FINE, PICKED)))
    counts = rows.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row a range
    total = max(counts.agg(F.sum("n")).first()[0] or 0, 1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("range").orderBy("key")
    ranked = rows.join(F.broadcast(begins), "range").withColumn("rank", F.col("begin") + F.row_number().over(within) - 1)
    at = F.expr(f"rank * {shards}L div {total}L")
    return ranked.withColumn("shard", at.cast("int")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        (F.col("rank") - F.expr(f"(shard * {total}L + {shards - 1}L) div {shards}L")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("key.hilbert").alias("hilbert"),
    )


def op8_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
