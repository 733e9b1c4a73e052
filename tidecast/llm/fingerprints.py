"""Operator 10 [native]: SpotSigs document fingerprints.

A text is lower-cased and cut into words (runs of letters and digits). Common words are anchors; a spot signature is the chain of the next
``CHAIN`` content words (words that aren't anchors) after an anchor, hashed to 32 bits. A fingerprint is the sorted set of a document's
signatures, written as hexadecimal numbers. A text without a signature has the hash of its words as its only one, so equal texts always have
equal fingerprints. The likeness of two fingerprints is their Jaccard similarity, of which lengths give a bound: sets with a
similarity of t or more differ in length by a factor of at most 1/t, so sets are partitioned by length in steps of 1/t and only sets of the same or
neighbouring partitions can be near. Of those, only such are compared whole as share one of the first n - ceil(t * n) + 1 signatures of either, in one order of all (``near``); the query tells so for each
document whether its edited text and its successor are near. ``near_groups`` joins all sets of a corpus by partition and rarest signatures.

``edited`` gives each text its counterpart: the last floor(n/4) code points are replaced by the first as many (or all) of the next document, by
ascending doc_id, after the last the first. Documents are dealt to ranges of (doc_id, hash of the text) that begin at keys picked by their hash, so ranges are even however
ids lie; each range's first document is copied to the range before it, so no order over all rows is needed, and texts are shuffled once.
DataFrame functions alone. Null texts count as empty; documents with one doc_id are ordered by a hash of their text, then by text; null ids come first; a single
document is its own next; very long texts are rows like others; an empty table gives an empty table. Further columns are not kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch, range_of, range_starts

CHAIN = 3
#: Documents in a range, about; keys that are picked for a range; keys at most (they are a constant of the plan).
RANGE_ROWS, FINE, PICKED = 500, 4, 1 << 18
#: The likeness from which fingerprints are near.
NEAR = 0.8
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the a an of to and in is it that was for on are with as be at by this from or not have has had were which you he they "
    "der die das und ist von zu den im ein eine nicht mit auf dem des sich als auch für es an "
    "le la les de des et un une est que qui dans pour pas sur au par plus ne se ce avec "
    "el los las y en con por del una no su para al lo como más o pero sus"
)
_MARK = "\u0001"


def _pattern(words: list[str]) -> str:
    """A pattern of the words that branches letter by letter."""
    out = []
    for first in sorted({w[0] for w in words if w}):
        rest = [w[1:] for w in words if w.startswith(first)]
        more = [w for w in rest if w]
        out.append(first + (_pattern(more) + ("?" if len(more) < len(rest) else "") if more else ""))
    return f"(?:{'|'.join(out)})"


def spots(text: Column, anchors: str = ANCHORS, chain: int = CHAIN) -> Column:
    """The sorted distinct signatures of a text, ``array<int>``."""
    listed = _pattern(sorted(set(anchors.split())))
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(words, "^ +| +$", " "), f" {listed}(?= )", f" {_MARK}")
    follow = rf"{_MARK}(?=((?:(?: {_MARK})* [^ {_MARK}]++){{{chain}}}))"
    chains = F.transform(F.regexp_extract_all(marked, F.lit(follow), F.lit(1)), lambda c: F.hash(F.replace(c, F.lit(f" {_MARK}"), F.lit(""))))
    # bound by a lambda, so that chains are found once though they are named twice
    return F.transform(F.array(chains), lambda c: F.sort_array(F.array_distinct(F.when(F.size(c) > 0, c).otherwise(F.array(F.hash(marked))))))[0]


def written(signatures: Column) -> Column:
    return F.array_join(F.transform(signatures, lambda h: F.lower(F.lpad(F.hex(h.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), ",")


def likeness(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def partition(n: Column, threshold: float = NEAR) -> Column:
    """The partition of sets of length ``n``: sets whose partitions differ by more than one cannot reach ``threshold``."""
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9).cast("int")


def prefix(signatures: Column, threshold: float = NEAR) -> Column:
    """The first signatures of a sorted set, so many that two sets that reach ``threshold`` have one of them in common."""
    n = F.size(signatures)
    return F.slice(signatures, F.lit(1), (n - F.ceil(threshold * n - 1e-9) + 1).cast("int"))


def near(a: Column, b: Column, like: Column, threshold: float = NEAR) -> Column:
    """Whether two sets reach ``threshold``: by their partitions, then their prefixes, and for what is left by their likeness."""
    apart = F.abs(partition(F.size(a), threshold) - partition(F.size(b), threshold)) > 1
    return F.when(apart, False).when(~F.arrays_overlap(prefix(a, threshold), prefix(b, threshold)), False).otherwise(like >= threshold)


# ---------------------------------------------------------------- next documents


def order_key() -> Column:
    """What documents are ordered by."""
    return F.struct(F.col("doc_id").isNotNull().cast("int").alias("some"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("hash"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, next_text, next_spots."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", order_key())
    s = Scratch(docs.sparkSession, "next")
    keys = s.save(rows.select("key"), "keys")
    kind = rows.schema["key"].dataType
    own_range = range_of("key", kind, range_starts(keys, RANGE_ROWS, FINE, PICKED))
    firsts = s.save(keys.groupBy(own_range.alias("range")).agg(F.min("key").alias("first")), "firsts")  # one row a range
    s.drop(keys)
    rows = rows.withColumn("range", own_range)
    last = firsts.agg(F.max("range")).first()[0] or 0
    begins = firsts.select("range", "first", F.coalesce(F.lag("range").over(Window.orderBy("range")), F.lit(last)).alias("to"))
    # of repeated rows each is a copy of the first: only the first in the window counts
    copies = rows.join(F.broadcast(begins), ["range"]).filter(F.col("key") == F.col("first"))
    copies = copies.groupBy(F.col("to").alias("range")).agg(F.min(F.struct("text", "doc_id", "key")).alias("c")).select("c.doc_id", "c.text", "c.key", "range")
    both = rows.withColumn("copy", F.lit(False)).unionByName(copies.withColumn("copy", F.lit(True))).withColumn("spots", spots(F.col("text")))
    follow = Window.partitionBy("range").orderBy("copy", "key", "text")
    out = both.withColumns({"next_text": F.lead("text").over(follow), "next_spots": F.lead("spots").over(follow)})
    return out.filter(~F.col("copy")).drop("range", "copy", "key")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, spots, next_spots, n_chars, edited, edited_spots."""
    out = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    out = out.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(next_text, 1, cast(n_chars div 4 as int)))"))
    return out.withColumn("edited_spots", spots(F.col("edited"))).drop("next_text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint."""
    return docs.select("doc_id", written(spots(F.col("text"))).alias("fingerprint"))


def near_groups(docs: DataFrame, threshold: float = NEAR) -> DataFrame:
    """doc_id, group_id (the smallest doc_id reached over likenesses of ``threshold`` or more), for every row."""
    from tidecast.llm.near_dup import linked_groups, with_leaders

    s = Scratch(docs.sparkSession, "spots")
    rows = s.save(docs.select("doc_id", spots(F.col("text")).alias("spots")).withColumn("class", F.sha2(written(F.col("spots")), 256)).withColumn("uid", F.monotonically_increasing_id()), "rows")
    classes = s.save(rows.groupBy("class").agg(F.min("uid").alias("v"), F.min("doc_id").alias("first")), "classes")
    sets = s.save(rows.join(classes.select(F.col("v").alias("uid")), "uid", "left_semi").select(F.col("uid").alias("v"), "spots"), "sets")
    each = sets.select("v", F.size("spots").alias("n"), F.explode("spots").alias("spot"))
    often = each.groupBy("spot").agg(F.count(F.lit(1)).alias("often"))
    # of a set of n, the n - ceil(t * n) + 1 rarest signatures: two sets that reach the threshold share one of them
    prefix = F.expr(f"n - cast(ceil({threshold}D * n - 1e-9D) as int) + 1")
    rare = each.join(often.filter("often > 1"), "spot", "left").groupBy("v", "n").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("o"), "spot"))).alias("spots"))
    part = partition(F.col("n"), threshold)
    rare = rare.select("v", part.alias("part"), F.explode(F.slice("spots", F.lit(1), prefix)).alias("s")).filter("s.o > 1")
    keys = rare.select("v", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"), "s.spot").select(F.xxhash64("spot", "part").alias("key"), "v")
    members = with_leaders(s, keys)

    def sets_of_ids(ids: DataFrame, name: str) -> DataFrame:
        return s.save(sets.join(ids, "v", "left_semi").select("v", F.col("spots").cast("array<long>").alias("set")), name)

    labels = linked_groups(s, members, sets.select("v", F.size("spots").cast("long").alias("n")), sets_of_ids, round(100 * threshold), None)
    labels = labels if labels is None else s.save(labels, "components")
    by_class = classes if labels is None else classes.join(labels, "v", "left")
    s.drop_all_but(rows, classes, *([] if labels is None else [labels]))
    by_class = by_class.withColumn("c", F.col("v") if labels is None else F.coalesce("c", "v"))
    least = by_class.groupBy("c").agg(F.min("first").alias("group_id"))
    return rows.select("doc_id", "class").join(by_class.join(least, "c").select("class", "group_id"), "class").select("doc_id", "group_id")


def op10_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    own, changed, following = F.col("spots"), F.col("edited_spots"), F.col("next_spots")
    rows = rows.withColumns({"near_edited": likeness(own, changed), "near_next": likeness(own, following)})
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        written(own).alias("fingerprint"),
        written(changed).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        near(own, changed, F.col("near_edited")).alias("edited_is_near"),
        near(own, following, F.col("near_next")).alias("next_is_near"),
    )
