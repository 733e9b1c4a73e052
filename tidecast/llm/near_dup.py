"""Operator 2: near-duplicate documents by MinHash with sequential Bayesian verification.

Words are runs of bytes that are not white space, A-Z lower-cased; a document's set holds its distinct runs of
``width`` words (of fewer words: the whole sequence; of none: the set is empty and links with nothing). Two documents
link if 100 * |A and B| >= 80 * |A or B|. A document's component is the smallest doc_id that it reaches.

1. One pass over the texts writes 128 MinHash values a document, in 32 bands of 4: a pair at the threshold shares no
   band with probability (1 - 0.8**4)**32, about 5e-8. Documents with equal sets become one vertex.
2. Within each band's bucket, members are compared with one leader (not with each other), so a group of any size
   costs its size. The comparison goes batch by batch over the signature: a pair is dropped as soon as the posterior
   probability of a similarity of 0.8 or more, under a uniform prior, falls below ``MISS``. What survives is verified on the full sets. Linked vertices merge.
3. Buckets whose members are not all in one component are gathered to units (buckets that share a component; where such a unit would be
   too large, the bucket alone). A unit's members outside its largest component are compared with all others, in blocks of bounded size:
   batch by batch as before, which leaves of each block the members that may link, and these by counting common shingles. A block gives at most one link for each two components that it joins.
   So no link between components is lost, and pairs are never listed.

Results: one row per input row. Null and blank texts have n_shingles 0 and their own component; rows with one doc_id
count as rows of their own, their component is the smallest doc_id among the rows they reach; an empty table gives an empty table. Further columns are not kept.
Tables that later steps need are written to the shared folder; nothing of the corpus comes to the driver but counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch, as_signed, byte_codes, byte_pieces, mix, ngram_hashes, span_hashes, word_spans

BANDS, ROWS = 32, 4
BATCH = 32
#: Posterior probability below which a candidate pair is given up.
MISS = 1e-9
THRESHOLD = 80
#: Shingles of one side of a block, about, and sides of a unit at most.
BLOCK, SIDES = 200_000, 48
#: Bits of the sieve of wanted ids for each of them, and bits at least and at most.
SIEVE_EACH, SIEVE_LEAST, SIEVE_MOST = 64, 1 << 16, 1 << 26

SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_CODES = byte_codes(fold=True)


def sets_of(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a column."""
    for first, end, data, offsets in byte_pieces(column):
        starts, ends, docs = word_spans(data, offsets, SPACE)
        words = span_hashes(data, starts, ends, _CODES)
        grams, at = ngram_hashes(words, docs, width)
        cut = np.searchsorted(docs[at], np.arange(end - first + 1))
        word_cut = np.searchsorted(docs, np.arange(end - first + 1))
        for k in range(end - first):
            if cut[k] < cut[k + 1]:
                yield np.unique(grams[cut[k] : cut[k + 1]])
            elif (n := word_cut[k + 1] - word_cut[k]) > 0:
                whole = np.frombuffer(hashlib.blake2b(words[word_cut[k] : word_cut[k + 1]].tobytes(), digest_size=8, salt=bytes([n])).digest(), np.uint64)
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def _key(x: np.ndarray) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(x.tobytes(), digest_size=16).digest(), np.int64)


_K = np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)
_A, _B = np.split(mix(_K * np.uint64(0x9E3779B97F4A7C15)), 2)
_A = (_A | np.uint64(1))[:, None]
_B = _B[:, None]


def signature(x: np.ndarray) -> np.ndarray:
    """MinHash values of a set, 32 bits each."""
    least = np.full((BANDS * ROWS, 1), np.iinfo(np.uint64).max)
    for at in range(0, len(x), 512):
        least = np.minimum(least, (_A * x[None, at : at + 512] + _B).min(axis=1, keepdims=True))
    return (least[:, 0] >> np.uint64(32)).astype("<u4")


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)
    for column in sig.reshape(BANDS, ROWS).T:
        h = mix(h ^ column.astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
    return as_signed(mix(h))


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, k1, k2 (hash of the set), sig, bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, keys, sigs, bands = [], [], [], []
            for x in sets_of(b.column(1), width):
                n.append(len(x))
                keys.append(_key(x))
                sig = signature(x) if len(x) else np.zeros(0, "<u4")
                sigs.append(sig.tobytes())
                bands.append(band_keys(sig) if len(x) else np.zeros(0, np.int64))
            if not n:
                continue
            keys = np.array(keys)
            at = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in bands])]).astype(np.int32))
            columns = [b.column(0), pa.array(n, pa.int64()), _longs(keys[:, 0].copy()), _longs(keys[:, 1].copy()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(at, _longs(np.concatenate(bands)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "k1", "k2", "sig", "bands"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n long, k1 long, k2 long, sig binary, bands array<long>")


class Sieve:
    """Bits of the hashes of the column ``on`` of ``ids``: what is not among them is mostly told without a shuffle, and all that is among them passes.

    With ``SIEVE_EACH`` bits for each id it lets one of that many others through, or fewer, up to about a million ids; ``SIEVE_MOST`` bits (8 MB) are all it ever takes, so beyond that it spares fewer."""

    def __init__(self, ids: DataFrame, on: str):
        self.bits = bits = min(max(SIEVE_LEAST, 1 << (SIEVE_EACH * ids.count() - 1).bit_length()), SIEVE_MOST)
        # 32 slots a word, so that at most bits / 32 words come to the driver
        slots = ids.select(self.slot(on))
        words = slots.groupBy((F.col("_slot") / 32).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, _slot % 32)")).alias("set")).toArrow()
        sieve = np.zeros(bits // 32, "<u4")
        sieve[words["word"].to_numpy()] = words["set"].to_numpy().astype("<u4")
        self.shared = ids.sparkSession.sparkContext.broadcast(sieve)

    def slot(self, on: str) -> Column:
        return F.pmod(F.xxhash64(on), F.lit(self.bits)).cast("int").alias("_slot")

    def sifted(self, rows: DataFrame, on: str) -> DataFrame:
        """The rows whose ``on`` may be among the ids."""
        return rows.select("*", self.slot(on)).mapInArrow(_sifting(self.shared), rows.schema)


def _sifting(shared: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keeps rows whose last column is a slot that is set, without that column."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = shared.value
        for b in batches:
            at = b.column(b.num_columns - 1).to_numpy()
            hit = pa.array((sieve[at >> 5] >> (at & 31).astype("<u4")) & 1 == 1)
            yield b.select(list(range(b.num_columns - 1))).filter(hit)

    return run


def full_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """doc_id, k1, k2, set (sorted shingle hashes) of the documents whose doc_id is in ``ids``, and of few others (see ``Sieve``)."""
    sieve = Sieve(ids, "doc_id")
    sift = _sifting(sieve.shared)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sift(batches):
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                sets = list(sets_of(part.column(1), width))
                keys = np.array([_key(x) for x in sets])
                cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32))
                columns = [part.column(0), _longs(keys[:, 0].copy()), _longs(keys[:, 1].copy()), pa.ListArray.from_arrays(cut, _longs(np.concatenate(sets)))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "k1", "k2", "set"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", sieve.slot("doc_id")).mapInArrow(run, f"doc_id {key}, k1 long, k2 long, `set` array<long>")


def least_matches(n: int, threshold: float, miss: float) -> int:
    """The fewest matches of ``n`` values with which P(similarity >= threshold | matches) is ``miss`` or more.

    Under a uniform prior the posterior is a Beta distribution, and that probability is P(Bin(n + 1, threshold) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def bayes_prune(pairs: DataFrame, threshold: int, miss: float) -> DataFrame:
    """Keeps of pairs (a, b, sig_a, sig_b) those that may reach the threshold: (a, b)."""
    stops = [(k, least_matches(k, threshold / 100, miss)) for k in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a_id, b_id = b.column(0), b.column(1)
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), "<u4").reshape(-1, BANDS * ROWS) for k in (2, 3))
            alive = np.arange(len(x))
            matches = np.zeros(len(x), np.int64)
            for stop, least in stops:
                part = slice(stop - BATCH, stop)
                matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            keep = pa.array(alive)
            yield pa.RecordBatch.from_arrays([a_id.take(keep), b_id.take(keep)], ["a", "b"])

    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def connected(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """Components of undirected ``edges`` (a, b): (v, c) with c the smallest vertex. Labels pass to neighbours and jump to their label's label."""
    both = scratch.save(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("c")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        new = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        to = labels.select(F.col("v").alias("c"), F.col("c").alias("d"))
        new = scratch.save(new.join(to, "c").select("v", "old", F.least("c", "d").alias("c")), "labels")
        changed = new.filter("c <> old").limit(1).count()
        scratch.drop(labels)
        labels = new
        if not changed:
            return labels.select("v", "c")


def units(s: Scratch, members: DataFrame, labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """(unit, block, v, c, side) for all that is still to be compared: side 0 and 1 of a block are compared with each other and side 0 with itself where the block's number says so.

    ``sizes`` has (v, n). Vertices of a unit's largest component are only compared with the others."""
    state = members.select("key", "v").join(labels, "v", "left").select("key", "v", F.coalesce("c", "v").alias("c"))
    # saved, so that the join is one of plain exchanges, which adaptive execution can split at hot keys
    open_keys = s.save(state.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key", "low"), "open")
    rest = s.save(state.join(open_keys, "key"), "rest")
    joined = connected(s, rest.filter("c <> low").select(F.col("low").alias("a"), F.col("c").alias("b")).distinct())
    each = rest.select("v", "c").distinct().join(joined.select(F.col("v").alias("c"), F.col("c").alias("unit")), "c").join(sizes, "v")
    each = s.save(each, "each")
    large = each.groupBy("unit").agg(F.sum("n").alias("all")).filter(F.col("all") > SIDES * BLOCK).select("unit")
    by_key = rest.select(F.col("key").alias("unit"), "v", "c").join(each.join(large, "unit", "left_semi").select("v", "n"), "v")
    each = s.save(each.join(large, "unit", "left_anti").select("unit", "v", "c", "n").unionByName(by_key.select("unit", "v", "c", "n")), "each")
    most = each.groupBy("unit", "c").agg(F.count(F.lit(1)).alias("k")).groupBy("unit").agg(F.max(F.struct("k", "c")).alias("m")).select("unit", F.col("m.c").alias("main"))
    each = each.join(most, "unit").withColumn("inner", F.col("c") == F.col("main"))
    size = lambda on: F.sum(F.when(on, F.col("n")))
    parts = lambda on: F.greatest(F.ceil(size(on) / BLOCK), F.lit(1)).cast("int")
    counts = each.groupBy("unit").agg(F.coalesce(parts(~F.col("inner")), F.lit(1)).alias("outs"), F.coalesce(parts(F.col("inner")), F.lit(1)).alias("ins"))
    each = each.join(counts, "unit").withColumn("i", F.pmod(F.xxhash64("v"), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))).cast("int"))
    block = lambda i, j, kind, side: F.struct((i.cast("long") * 4_000_000 + j * 2 + kind).alias("block"), F.lit(side).alias("side"))
    i = F.col("i")
    upward = F.transform(F.sequence(i, F.col("outs") - 1), lambda j: block(i, j, 0, 0))
    downward = F.when(i > 0, F.transform(F.sequence(F.lit(0), F.greatest(i - 1, F.lit(0))), lambda j: block(j, i, 0, 1))).otherwise(F.array().cast("array<struct<block: bigint, side: int>>"))
    across = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda j: block(i, j, 1, 0))
    outer = F.concat(upward, downward, across)
    inner = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda j: block(j, i, 1, 1))
    return each.withColumn("b", F.explode(F.when(F.col("inner"), inner).otherwise(outer))).select("unit", "b.block", "v", "c", "b.side")


def prune_blocks(blocks: DataFrame, threshold: int, miss: float) -> DataFrame:
    """The rows of blocks (unit, block, v, c, side, n, sig) that another component's may link with in that block, judged batch by batch: without n and sig."""
    stops = [(k, least_matches(k, threshold / 100, miss)) for k in range(BATCH, BANDS * ROWS + 1, BATCH)]

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, side, n = (table[x].to_numpy() for x in ("c", "side", "n"))
        itself = int(table["block"][0].as_py()) % 2 == 0 and (side == 0).all()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), "<u4").reshape(len(c), -1)
        hit = np.zeros(len(c), bool)
        other = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0).tolist():
            if itself:
                other = np.arange(i + 1, len(c))
            alive = other[(c[other] != c[i]) & (100 * np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i]))]
            matches = np.zeros(len(alive), np.int64)
            for stop, least in stops:
                part = slice(stop - BATCH, stop)
                matches = matches + (sig[alive, part] == sig[i, part]).sum(axis=1)
                alive, matches = alive[matches >= least], matches[matches >= least]
            hit[alive] = True
            hit[i] |= len(alive) > 0
        return table.select(["unit", "block", "v", "c", "side"]).filter(pa.array(hit))

    return blocks.groupBy("unit", "block").applyInArrow(run, "unit long, block long, v long, c long, side int")


def compare_blocks(blocks: DataFrame, threshold: int) -> DataFrame:
    """Links (a, b) between components within blocks (unit, block, v, c, side, set)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        v, c, side = (table[x].to_numpy() for x in ("v", "c", "side"))
        itself = int(table["block"][0].as_py()) % 2 == 0 and (side == 0).all()
        sets = table["set"].chunk(0)
        n = np.asarray(sets.value_lengths().to_numpy(zero_copy_only=False), np.int64)
        _, code = np.unique(np.asarray(sets.flatten().to_numpy(zero_copy_only=False)), return_inverse=True)
        owner = np.repeat(np.arange(len(v)), n)
        order = np.argsort(code, kind="stable")
        posted, at = owner[order], np.searchsorted(code[order], np.arange(code.max() + 2 if len(code) else 1))
        cut = np.concatenate([[0], np.cumsum(n)])
        parent = {x: x for x in c.tolist()}

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        other = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0).tolist():
            if itself:
                other = np.arange(i + 1, len(v))
            alive = other[100 * np.minimum(n[other], n[i]) >= threshold * np.maximum(n[other], n[i])]
            own = root(int(c[i]))
            alive = alive[[root(x) != own for x in c[alive].tolist()]] if len(alive) else alive
            if not len(alive):
                continue
            mine = code[cut[i] : cut[i + 1]]
            lengths = at[mine + 1] - at[mine]
            places = np.repeat(at[mine] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            shared = np.bincount(posted[places], minlength=len(v))[alive]
            for j in alive[100 * shared >= threshold * (n[i] + n[alive] - shared)].tolist():
                x, y = root(int(c[i])), root(int(c[j]))
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((v[i], v[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return blocks.groupBy("unit", "block").applyInArrow(run, "a long, b long")


def with_leaders(s: Scratch, keys: DataFrame) -> DataFrame:
    """(key, v, w) of ``keys`` (key, v) that two rows or more have, saved; w is the member that leads the key.

    Sizes and leaders are counted before the shuffle and saved, so the join is one of plain exchanges, which adaptive execution can split at hot keys; of the keys of one row only, few are shuffled a second time."""
    sums = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("v").alias("w"))
    leaders = s.save(sums.filter("size > 1").select("key", "w"), "leaders")
    return s.save(Sieve(leaders, "key").sifted(keys, "key").join(leaders, "key"), "members")


def linked_groups(s: Scratch, members: DataFrame, sizes: DataFrame, sets_of_ids: Callable[[DataFrame, str], DataFrame], threshold: int, miss: float | None) -> DataFrame | None:
    """Components (v, c) of the graph of links among vertices that share a key; None without any to look for.

    ``members`` has (key, v, w), a saved table that names every pair that may link by a common key; ``sizes`` has (v, n) and, if ``miss`` is given, sig;
    ``sets_of_ids`` takes ids (v) and gives (v, set), saved."""
    if members.limit(1).count() == 0:
        return None
    more = ["sig"] if miss else []
    pairs = s.save(members.filter("v <> w").select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct(), "pairs")
    sieve = Sieve(pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct(), "v")
    paired = sieve.sifted(sizes, "v")  # signatures of those in a pair only are shuffled
    a = paired.select(F.col("v").alias("a"), F.col("n").alias("n_a"), *(F.col(x).alias("sig_a") for x in more))
    b = paired.select(F.col("v").alias("b"), F.col("n").alias("n_b"), *(F.col(x).alias("sig_b") for x in more))
    near = pairs.join(a, "a").join(b, "b").filter(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    near = s.save(bayes_prune(near, threshold, miss) if miss else near.select("a", "b"), "candidates")
    sets = sets_of_ids(near.select(F.col("a").alias("v")).union(near.select("b")).distinct(), "led")
    sa, sb = (sets.select(F.col("v").alias(x), F.col("set").alias(f"set_{x}")) for x in "ab")
    common = near.join(sa, "a").join(sb, "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    links = s.save(common.filter(f"100L * common >= {threshold}L * (n_a + n_b - common)").select("a", "b"), "links")
    labels = connected(s, links)
    blocks = units(s, members, labels, sizes.select("v", "n"))
    if miss:  # signatures are a fraction of the sets; only what they leave is compared whole
        blocks = s.save(blocks.select("unit", "block", "v", "c", "side"), "repeated")
        signed = Sieve(blocks.select("v").distinct(), "v").sifted(sizes.select("v", "n", "sig"), "v")
        blocks = prune_blocks(blocks.join(signed, "v"), threshold, miss)
    blocks = s.save(blocks, "blocks")
    rows = blocks.join(sets_of_ids(blocks.select("v").distinct(), "rest"), "v")
    return connected(s, s.save(links.union(compare_blocks(rows, threshold)), "links"))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD, miss: float = MISS, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept. The result reads three narrow tables of ``scratch``; the others are dropped."""
    s = scratch or Scratch(docs.sparkSession, "near-dup")
    rows = s.save(sketch(docs, width).withColumn("uid", F.monotonically_increasing_id()), "sketch")
    classes = s.save(rows.filter("n > 0").groupBy("k1", "k2").agg(F.min("uid").alias("v"), F.min("doc_id").alias("first")), "classes")
    reps = rows.join(classes.select(F.col("v").alias("uid")), "uid", "left_semi")
    keys = reps.select(F.col("uid").alias("v"), F.explode("bands").alias("key"))
    members = with_leaders(s, keys)

    def sets_of_ids(ids: DataFrame, name: str) -> DataFrame:
        wanted = s.save(rows.select("uid", "doc_id", "k1", "k2").join(ids.withColumnRenamed("v", "uid"), "uid", "left_semi"), f"wanted-{name}")
        found = full_sets(docs, wanted, width).join(wanted.select("uid", F.col("doc_id").alias("own"), "k1", "k2"), ["k1", "k2"])
        # equal sets of other documents that the sieve let through, and of repeated rows, are left out
        first = found.filter("doc_id = own").dropDuplicates(["uid"]) if repeated else found.filter("doc_id = own")
        return s.save(first.select(F.col("uid").alias("v"), "set"), f"sets-{name}")

    repeated = rows.groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    labels = linked_groups(s, members, rows.select(F.col("uid").alias("v"), "n", "sig"), sets_of_ids, threshold, miss)
    ids = s.save(rows.select("doc_id", "n", "k1", "k2"), "ids")
    if labels is None:
        s.drop_all_but(ids, classes)
    else:
        labels = s.save(labels, "components")
        s.drop_all_but(ids, classes, labels)
    by_class = classes.select("k1", "k2", "v", "first")
    if labels is not None:
        by_class = by_class.join(labels, "v", "left").withColumn("c", F.coalesce("c", "v"))
        least = by_class.groupBy("c").agg(F.min("first").alias("component_id"))
        by_class = by_class.join(least, "c").select("k1", "k2", "component_id")
    else:
        by_class = by_class.select("k1", "k2", F.col("first").alias("component_id"))
    out = ids.join(by_class, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def keep_first(docs: DataFrame, width: int = 5, threshold: int = THRESHOLD) -> DataFrame:
    """The documents, all columns, of which none with a smaller doc_id is in their component; repeated rows all stay or all go.

    Only the ids of those that go are joined to the texts."""
    s = Scratch(docs.sparkSession, "near-dup")
    marks = s.save(near_duplicates(docs, width, threshold, scratch=s).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    s.drop_all_but(marks)
    return docs.join(marks.hint("shuffle_hash"), "doc_id", "left_anti").select(docs.columns)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4)
