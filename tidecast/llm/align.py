"""Operator 13: alignment of two tokenizers' tokens, with counts of linked ids over the corpus, from postings that are cogrouped.

Space+text is encoded by a byte-level vocabulary (A) and the text by a piece vocabulary (B, which adds the space itself), both without special tokens. Both see the same bytes, so tokens are laid over each other by byte offset: an
A and a B token that end together are linked, and such ends cut both into groups.

1. *Encoding.* A text is cut before spaces that stand between two characters other than white space. Neither vocabulary has a token across such a place (checked for the pieces when they are loaded), so equal chunks give equal tokens, links and groups, which
   are remembered as long as they are met. Chunks whose tokens do not spell their bytes make the whole text one without tokens. A row is written for each text: counts, hash of the groups, and the multiplicity of each linked pair of ids.
2. *Postings.* Pairs are counted by ids (partial sums before the shuffle). Then postings (pair, row, multiplicity) and counts are dealt by the B id into one stream a task, sorted by B id with counts ahead of postings. Spark's sort spills, and a task
   holds the counts of one B id at a time, of which there are at most as many as A has ids: it finds the largest, gives each posting its count, and adds up what it has by row before it passes it on.
   B ids of more than ``SPLIT`` postings are dealt into parts by row, each with the counts of the id, so a frequent id is no task's burden.
3. *Sums.* Contributions are summed by row.

Results: one row per input row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Texts that are null, empty or not spelled by their tokens have zeros and ''. Rows with one doc_id, and repeated rows, are rows of their own, and each counts. A very
long text is cut into chunks like others; chunks of more than ``REMEMBER`` characters are encoded but not remembered. An empty table gives an empty table. Further columns are not kept, whatever their names. Very long texts hold their own pairs in one row.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm._shared import Scratch
from tidecast.llm.token_counts import PATTERN

#: Chunks that are remembered: their length, and their number. When half as many are new or were met again, those not met meanwhile are forgotten.
REMEMBER, CHUNKS = 40, 400_000
#: Postings of one B id, about, that one part of it holds.
SPLIT = 100_000
#: Rows in a contribution before a task passes it on.
HELD = 100_000
_CUT = re.compile(r" (?<=\S )(?=\S)")


def byte_values() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Chunk(NamedTuple):
    """What a chunk of text becomes; ``groups`` is None where the tokens do not spell it. A pair is one number of eight bytes: B's id above A's. ``sizes`` has the number of B's tokens above that of A's."""

    groups: str | None
    pairs: bytes
    sizes: int


class Aligner:
    def __init__(self, a: str, b: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        value = byte_values()
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        self.a_bytes = {i: special.get(i) or bytes(value[c] for c in t) for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("pieces reach across spaces, so texts cannot be cut at spaces")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if not all(self.a_bytes.values()) or not all(self.b_bytes):
            raise ValueError("a token without bytes ends nowhere of its own")
        self.a_lengths, self.b_lengths = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(x) for x in self.b_bytes])
        for i, x in self.a_bytes.items():
            self.a_lengths[i] = len(x)
        # each id's decimal digits, flush right before a place for the mark that follows it
        decimal = [f"{i} ".encode() for i in range(max(len(self.a_lengths), len(self.b_bytes)))]
        width = len(decimal[-1])
        self.wide = np.array([len(x) for x in decimal])
        self.digits = np.frombuffer(b"".join(x.rjust(width) for x in decimal), np.uint8).reshape(-1, width)
        self.written = np.arange(width) >= width - self.wide[:, None]
        self.encode_a = self.ranked(json.loads(a)) or (lambda text: self.a.encode(text, add_special_tokens=False).ids)
        self.known: dict[str, Chunk] = {}
        self.older: dict[str, Chunk] = {}

    def ranked(self, spec: dict) -> Callable[[str], list[int]] | None:
        """An encoder by ranks, several times faster for short texts, if the vocabulary's ids follow its merges and it splits texts by the usual pattern; else None."""
        import tiktoken

        merges, vocabulary = (spec["model"][k] for k in ("merges", "vocab"))
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        first = len(vocabulary) - len(merged)
        usual = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        if spec["normalizer"] or usual.items() - (spec["pre_tokenizer"] or {}).items() or any(vocabulary[t] != first + k for k, t in enumerate(merged)):
            return None
        ranks = {self.a_bytes[i]: i for i in vocabulary.values()}
        return tiktoken.Encoding("aligned", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def learn(self, chunks: list[str]) -> list[Chunk]:
        """Chunks without their leading space, which both encoders add."""
        spaced = [" " + c for c in chunks]
        ids_a, ids_b, spelled = list(map(self.encode_a, spaced)), self.b.encode(chunks, num_threads=1), list(map(str.encode, spaced))
        out = self.laid(ids_a, ids_b, spelled)
        if out is None:
            out = [(self.laid([a], [b], [s]) or [Chunk(None, b"", 0)])[0] for a, b, s in zip(ids_a, ids_b, spelled, strict=True)]
        return out

    def laid(self, ids_a: list[list[int]], ids_b: list[list[int]], spelled: list[bytes]) -> list[Chunk] | None:
        """Chunks whose tokens are laid over each other in one array: ends are counted from the first chunk's beginning, and each chunk's end is an end of both. None if the tokens of any do not spell it."""
        whole, until = b"".join(spelled), np.cumsum(list(map(len, spelled)))
        flat, ends, last = [], [], []
        for ids, of, lengths in ((ids_a, self.a_bytes, self.a_lengths), (ids_b, self.b_bytes, self.b_lengths)):
            tokens = list(chain.from_iterable(ids))
            if b"".join([of[i] for i in tokens]) != whole:
                return None
            flat.append(np.array(tokens, np.int64))
            ends.append(np.cumsum(lengths[flat[-1]]))
            last.append(np.cumsum(list(map(len, ids))))
            if not np.array_equal(ends[-1][last[-1] - 1], until):  # a chunk has a byte at least, so without tokens it differs
                return None
        (a, b), (end_a, end_b) = flat, ends
        at = np.zeros(len(whole) + 1, bool)  # no token has no bytes, so an end is that of one token of each
        at[end_a] = True
        last_b = at[end_b]
        at[end_a] = False
        at[end_b] = True
        last_a = at[end_a]
        pairs = b[last_b] << 32 | a[last_a]
        # the tokens of both in the order of the groups, A's before B's, each with the mark that follows it
        of_a, of_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        at_a, at_b = np.flatnonzero(last_a), np.flatnonzero(last_b)
        place_a, place_b = np.arange(len(a)) + np.r_[0, at_b + 1][of_a], np.arange(len(b)) + (at_a + 1)[of_b]
        words, marks = np.empty(len(a) + len(b), np.int64), np.empty(len(a) + len(b), np.uint8)
        words[place_a], words[place_b] = a, b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        digits = self.digits[words]
        digits[:, -1] = marks
        text, pairs = digits[self.written[words]].tobytes().decode("ascii"), pairs.tobytes()
        letters = np.cumsum(self.wide[words])[last[0] + last[1] - 1].tolist()
        groups = (np.cumsum(last_b)[last[1] - 1] * 8).tolist()
        sizes = (np.diff(last[1], prepend=0) << 32 | np.diff(last[0], prepend=0)).tolist()
        out, letter, pair = [], 0, 0
        for to, end, size in zip(letters, groups, sizes, strict=True):
            out.append(Chunk(text[letter : to - 1], pairs[pair:end], size))
            letter, pair = to, end
        return out

    def chunks(self, texts: list[str]) -> list[list[Chunk]]:
        if len(self.known) > CHUNKS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        cut = [_CUT.split(t) for t in texts]
        new = set(chain.from_iterable(cut)).difference(known)
        again = [c for c in new if c in older]
        known.update(zip(again, map(older.__getitem__, again), strict=True))
        new = list(new.difference(again))
        passing: dict[str, Chunk] = {}
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            for c, x in zip(part, self.learn(part), strict=True):
                (known if len(c) <= REMEMBER else passing)[c] = x
        if passing:
            return [[known[c] if c in known else passing[c] for c in each] for each in cut]
        return [list(map(known.__getitem__, each)) for each in cut]


@functools.lru_cache(maxsize=2)
def aligner(a: str, b: bytes) -> Aligner:
    return Aligner(a, b)


def aligned(docs: DataFrame, a: str, b: bytes) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and the linked pairs of the row: ids_a, ids_b, times. ``a`` and ``b`` are the vocabularies' contents."""
    shared = docs.sparkSession.sparkContext.broadcast((a, b))
    key = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids_a", "ids_b", "times"]

    none = np.zeros(0, np.int64)

    def row(chunks: list[Chunk]) -> tuple:
        groups, pairs, sizes = zip(*chunks, strict=True) if chunks else ((None,), (), ())
        if None in groups:
            return 0, 0, 0, "", none, none
        digest, size = hashlib.sha256(";".join(groups).encode()).hexdigest(), sum(sizes)
        pairs = np.frombuffer(b"".join(pairs), np.int64)  # each ends a group
        return size & 0xFFFFFFFF, size >> 32, len(pairs), digest, *np.unique(pairs, return_counts=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = aligner(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = part.column(1).to_pylist()
                found = iter(tool.chunks([t for t in texts if t]))
                n_a, n_b, n, digest, pairs, times = zip(*(row(next(found) if t else []) for t in texts), strict=True)
                starts = pa.array(np.r_[0, np.cumsum(list(map(len, pairs)))], pa.int32())
                pairs, times = np.concatenate(pairs), np.concatenate(times)
                lists = [pa.ListArray.from_arrays(starts, pa.array(x.astype(np.int32))) for x in (pairs & 0xFFFFFFFF, pairs >> 32, times)]
                counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, n, n)]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array(digest, pa.string()), *lists], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids_a array<int>, ids_b array<int>, times array<int>")


def contributions(stream: DataFrame) -> DataFrame:
    """(uid, best, total) from a stream sorted by b, part, kind: counts (kind 0: a, n) ahead of postings (kind 1: a, n, uid). A uid may come several times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["uid", "best", "total"]
        ids, count, own = np.zeros(0, np.int64), np.zeros(0, np.int64), (-1, -1)
        held, size = [], 0

        def passed() -> pa.RecordBatch:
            uid, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = [np.zeros(len(uid), np.int64) for _ in range(2)]
            for s, k in zip(sums, (1, 2), strict=True):
                np.add.at(s, at, np.concatenate([h[k] for h in held]))
            return pa.RecordBatch.from_arrays([pa.array(uid), *map(pa.array, sums)], names)

        for batch in batches:
            b, part, kind, a, n, uid = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(6))
            edges = np.flatnonzero((b[1:] != b[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, len(b)], strict=True):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    if (b[lo], part[lo]) == own:  # a batch ended within the counts
                        ids, count = np.append(ids, a[lo:hi]), np.append(count, n[lo:hi])
                    else:
                        ids, count, own = a[lo:hi], n[lo:hi], (b[lo], part[lo])
                else:
                    got = count[np.searchsorted(ids, a[lo:hi])]  # counts come in order of a
                    held.append((uid[lo:hi], np.where(got == count.max(), n[lo:hi], 0), n[lo:hi] * got))
                    size += hi - lo
            if size > HELD:
                yield passed()
                held, size = [], 0
        if size:
            yield passed()

    return stream.select("b", "part", "kind", "a", "n", "uid").mapInArrow(run, "uid long, best long, total long")


def cogrouped(postings: DataFrame) -> DataFrame:
    """(uid, best, total): sums over the postings (uid, a, b, n) of n where the pair's count is b's highest, and of n times the count."""
    counts = postings.groupBy("b", "a").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    parts = counts.groupBy("b").agg(F.ceil(F.sum("rows") / SPLIT).cast("int").alias("parts"))  # at most a row for each id of the vocabulary
    parts = F.broadcast(parts)
    long = F.lit(None).cast("long")
    left = counts.join(parts, "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("a").cast("long").alias("a"), "n", F.coalesce(long, F.lit(0)).alias("uid"))
    right = postings.join(parts, "b").select("b", F.pmod(F.xxhash64("uid"), "parts").cast("int").alias("part"), F.lit(1).alias("kind"), F.col("a").cast("long").alias("a"), F.col("n").cast("long").alias("n"), "uid")
    dealt = left.unionByName(right).repartition("b", "part").sortWithinPartitions("b", "part", "kind", "a")
    return contributions(dealt).groupBy("uid").agg(F.sum("best").alias("best"), F.sum("total").alias("total"))


def alignment(docs: DataFrame, a: str, b: bytes, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of ``docs`` (doc_id, text)."""
    s = scratch or Scratch(docs.sparkSession, "align")
    rows = s.save(aligned(docs, a, b).withColumn("uid", F.monotonically_increasing_id()), "rows")
    postings = rows.select("uid", F.explode(F.arrays_zip("ids_a", "ids_b", "times")).alias("p")).select("uid", F.col("p.ids_a").alias("a"), F.col("p.ids_b").alias("b"), F.col("p.times").alias("n"))
    sums = cogrouped(postings)
    none = F.lit(0).cast("long")
    out = rows.select("uid", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(sums, "uid", "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("best", none).alias("n_best"), F.coalesce("total", none).alias("count_sum"), "groups_sha256")


def vocabularies(a: str, b: str) -> tuple[str, bytes]:
    """The contents of two vocabulary files."""
    with open(a, encoding="utf-8") as x, open(b, "rb") as y:
        return x.read(), y.read()


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return alignment(spark.read.parquet(f"{sf_dir}/documents.parquet"), *vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")))
