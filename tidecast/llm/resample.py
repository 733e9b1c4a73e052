"""Operator 12: importance resampling of documents towards a target distribution, with n-grams from a table of positions.

Words are runs of digits, letters a-z and characters beyond ASCII, after lower-casing A-Z alone. A document's words are laid out by ``posexplode``, a row for each position; for the orders 2 to
``order``, ``lead()`` over the document's positions gives the words that follow, joined by one space (order 1 is the word alone and needs no window). Each n-gram falls in a bucket by its crc32.
A bucket's gain is the logarithm of its share of the target's n-grams over its share of the corpus's, both with one added to each bucket, in thousandths rounded down. Gains (at most ``buckets`` rows, so broadcast) are joined to
the position table, and a document's weight is their sum. Score is weight plus Gumbel noise from a hash of the doc_id, so that the highest scores are a draw without replacement in proportion to the weights.

Counts by bucket and sums by document are aggregated before they are shuffled: a document's positions lie in one task, so neither its words nor a frequent word's rows meet anywhere. For orders above 1 texts are dealt by row
before they are laid out, so that the window needs no second shuffle. Ranks are counted in ranges of the whole order, none of which holds more than some thousands of rows.

Results: one row per input row: doc_id, n_features, weight, score, rank. Null and empty texts have no features and weight 0. Rows with one doc_id are rows of their own with the same noise; a null doc_id counts as the empty text there, and as the
largest in ties. Rows that are equal in score and doc_id are ranked by features. Without target or corpus words all gains are of the one added. Empty tables give empty tables. Further columns are not kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch, range_of, range_starts

BUCKETS, SEED = 10_000, 2024
PERCENT, LEAST_WORDS = 10, 20
#: Rows of a range of the order, about; keys that are picked for a range; keys at most (they are a constant of the plan).
RANGE_ROWS, FINE, PICKED = 5_000, 4, 1 << 18
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), _BREAKS), lambda w: w != "")


def ngrams(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """The rows (uid, doc_id, text) without their text, for each n-gram of orders 1 to ``order`` with its bucket and its number ``n`` of words; rows without words once, with nulls."""
    if order > 1:
        rows = rows.repartition("uid")
    at = rows.select("uid", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    n, gram = F.when(F.col("word").isNotNull(), 1), F.col("word")
    if order > 1:
        following = Window.partitionBy("uid").orderBy("pos")
        for k in range(1, order):
            at = at.withColumn(f"next_{k}", F.lead("word", k).over(following))
        # concat is null where a word is missing
        longer = [F.concat(F.col("word"), *(x for k in range(1, n) for x in (F.lit(" "), F.col(f"next_{k}")))) for n in range(2, order + 1)]
        each = F.array(*(F.struct(F.lit(n).alias("n"), g.alias("gram")) for n, g in enumerate([F.col("word"), *longer], 1)))
        at = at.select("uid", "doc_id", F.explode_outer(F.filter(each, lambda g: g["gram"].isNotNull())).alias("g"))
        n, gram = F.col("g.n"), F.col("g.gram")
    return at.select("uid", "doc_id", n.alias("n"), F.pmod(F.crc32(gram), F.lit(buckets)).cast("int").alias("bucket"))


def numbered(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.monotonically_increasing_id().alias("uid"))


def gains(corpus: DataFrame, target: DataFrame, order: int, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket."""
    spark = corpus.sparkSession
    count = lambda df, name: ngrams(numbered(df.select(F.lit(0).alias("doc_id"), "text")), order, buckets).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias(name))
    each = spark.range(buckets).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(count(corpus, "s")), "bucket", "left").join(F.broadcast(count(target, "t")), "bucket", "left").fillna(0, ["s", "t"])
    return with_gain(each, buckets)


def with_gain(each: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) from counts (bucket, s, t) of all buckets."""
    every = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # over ``buckets`` rows
    d = lambda x: x.cast("double")
    all_s, all_t = F.sum("s").over(every), F.sum("t").over(every)
    share = (d(F.col("t") + 1) * d(all_s + buckets)) / (d(F.col("s") + 1) * d(all_t + buckets))
    return each.select("bucket", F.floor(1000 * F.log(share)).cast("long").alias("gain"))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, from the first 32 bits of a hash."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scores: DataFrame, percent: int, least_words: int) -> DataFrame:
    """Adds ``rank`` to the highest scores, ``percent`` of the rows of ``least_words`` words or more; ties go to the smaller doc_id. ``scores`` is a saved table."""
    able = scores.filter(F.col("n_words") >= least_words)
    n = able.count()
    drawn = percent * n // 100
    key = F.struct((-F.col("score")).alias("below"), F.col("doc_id").isNull().alias("last"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), "n_features", "weight")
    able = able.withColumn("key", key)
    able = able.withColumn("range", range_of("key", able.schema["key"].dataType, range_starts(able.select("key"), RANGE_ROWS, FINE, PICKED)))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    begins = able.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    within = Window.partitionBy("range").orderBy("key")
    placed = able.join(F.broadcast(begins), "range").withColumn("at", F.col("begin") + F.row_number().over(within))
    rank = F.when(F.col("at") <= drawn, F.col("at")).cast("long").alias("rank")
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    return placed.select(*columns, rank).unionByName(scores.filter(F.col("n_words") < least_words).select(*columns, none))


def resample(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of ``docs`` (doc_id, text), towards the texts of ``target``."""
    s = scratch or Scratch(docs.sparkSession, "resample")
    gain = s.save(gains(docs, target, order, buckets), "gains")
    grams = ngrams(numbered(docs), order, buckets).join(F.broadcast(gain), "bucket", "left")
    # a document's rows lie in one task, so that only its sums are shuffled
    sums = grams.groupBy("uid", "doc_id").agg(F.count("n").alias("n_features"), F.count(F.when(F.col("n") == 1, 1)).alias("n_words"), F.coalesce(F.sum("gain"), F.lit(0)).cast("long").alias("weight"))
    scores = sums.select("doc_id", "n_features", "n_words", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"))
    return ranked(s.save(scores, "scores"), percent, least_words)


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
