"""Operator 5: edit-aware token counts.

A document's state is a segment tree over its pre-tokens (the pieces that byte-pair encoding never crosses): leaves hold the lengths and token
counts of up to ``LEAF`` neighbouring pre-tokens, inner nodes the sums of characters and tokens below. An edit (replace the characters
start to end by a text) finds its leaf from the root, re-splits from the last pre-token that ends at least two characters before the edit (a
pre-token depends on no more than that) until a boundary after the edit coincides with an old one, encodes the new pre-tokens only, and
updates the sums on the paths to the root. So a change costs the edited region and the tree's height, not the document.

``build`` makes states from texts, ``apply_edits`` applies a log of edits (doc_id, seq, start, end, replacement; each in the coordinates of the
text that the one before left; offsets are cut to the text; equal seq by start, end, replacement), at most ``ROUND`` of a document in a round, so that no group grows without bound.
Null texts count as empty, null replacements as nothing. Edits of unknown documents have no effect; documents with one doc_id each get the
edits. Further columns are not kept. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LEAF = 64
ROUND = 1000
CACHE = 300_000
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PATTERN)


class Counter:
    """Tokens of a pre-token, remembered."""

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        self.known: dict[str, int] = {}

    def counts(self, pieces: list[str]) -> list[int]:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        if new := [p for p in set(pieces) if p not in known]:
            encode = self.encoding.encode_ordinary
            for p in new:
                known[p] = len(encode(p))
        return list(map(known.__getitem__, pieces))


@functools.lru_cache(maxsize=2)
def _counter(ranks: bytes) -> Counter:
    return Counter(ranks)


class TokenTree:
    """Leaves of (lengths, counts) under a complete binary tree of sums; node 1 is the root, leaf i is node ``self.cap + i``."""

    def __init__(self, lengths: list[int], counts: list[int]):
        self.leaves = [(lengths[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(lengths), LEAF)] or [([], [])]
        self.cap = 1 << (len(self.leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.cap), [0] * (2 * self.cap)
        for i, (a, b) in enumerate(self.leaves):
            self.chars[self.cap + i], self.tokens[self.cap + i] = sum(a), sum(b)
        for k in range(self.cap - 1, 0, -1):
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    @classmethod
    def of(cls, text: str, counter: Counter) -> TokenTree:
        pieces = _PIECES.findall(text)
        return cls(list(map(len, pieces)), counter.counts(pieces))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    def flat(self) -> tuple[list[int], list[int]]:
        return [x for a, _ in self.leaves for x in a], [x for _, b in self.leaves for x in b]

    def leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before = 1, 0
        while node < self.cap:
            node *= 2
            if position >= before + self.chars[node]:
                before += self.chars[node]
                node += 1
        leaf = min(node - self.cap, len(self.leaves) - 1)
        while leaf and not self.leaves[leaf][0]:  # beyond the last character
            leaf -= 1
            before -= self.chars[self.cap + leaf]
        return leaf, before

    def put(self, leaf: int, lengths: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (lengths, counts)
        node = self.cap + leaf
        self.chars[node], self.tokens[node] = sum(lengths), sum(counts)
        while node := node // 2:
            self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """The edited text and the number of pre-tokens encoded for it; ``text`` is what the tree stands for."""
        start = min(max(start, 0), len(text))
        end = min(max(end, start), len(text))
        shift = len(new) - (end - start)
        after = text[:start] + new + text[end:]
        first, at = self.leaf_at(max(start - 2, 0))
        while first and (not self.leaves[first][0] or at + self.leaves[first][0][0] > start - 2):  # a boundary to start from may stand in the leaf before
            first -= 1
            at -= self.chars[self.cap + first]
        keep = 0
        lengths, counts = self.leaves[first]
        while keep < len(lengths) and at + lengths[keep] <= start - 2:
            at += lengths[keep]
            keep += 1
        old_leaf, old_index, old_at = first, keep, at  # the old boundaries, one after another
        pieces: list[str] = []
        position = at
        scan = _PIECES.finditer(after, at)
        while True:
            if position >= start + len(new):
                while old_at + shift < position:
                    while old_index >= len(self.leaves[old_leaf][0]):
                        old_leaf, old_index = old_leaf + 1, 0
                    old_at += self.leaves[old_leaf][0][old_index]
                    old_index += 1
                if old_at + shift == position and old_at >= end:
                    break
            piece = next(scan, None)
            if piece is None:  # the text's end, which is the old one's
                old_leaf, old_index = len(self.leaves) - 1, len(self.leaves[-1][0])
                break
            pieces.append(piece.group())
            position = piece.end()
        tail = self.leaves[old_leaf]
        lengths, counts = lengths[:keep] + list(map(len, pieces)) + tail[0][old_index:], counts[:keep] + counter.counts(pieces) + tail[1][old_index:]
        for leaf in range(first + 1, old_leaf + 1):
            self.put(leaf, [], [])
        self.put(first, lengths, counts)
        if len(lengths) > 8 * LEAF:
            self.__init__(*self.flat())
        return after, len(pieces)


def _ranks(spark: SparkSession, path: str):
    with open(path, "rb") as f:  # a vocabulary has a fixed size
        return spark.sparkContext.broadcast(f.read())


_TREE = "lengths array<int>, counts array<int>"


def build(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, n_tokens, lengths, counts: the state of each document."""
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                trees = [TokenTree.of(t or "", counter) for t in part.column(1).to_pylist()]
                flat = [t.flat() for t in trees]
                columns = [*part.columns, pa.array([t.n_tokens for t in trees], pa.int64()), *(pa.array([f[k] for f in flat], pa.list_(pa.int32())) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "n_tokens", "lengths", "counts"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, text string, n_tokens long, {_TREE}")


def apply_edits(states: DataFrame, edits: DataFrame, path: str) -> DataFrame:
    """The states after the edits, and ``n_encoded``: pre-tokens encoded for them."""
    ranks = _ranks(states.sparkSession, path)
    order = Window.partitionBy("doc_id").orderBy("seq", "start", "end", "replacement")
    numbered = edits.select("doc_id", "seq", "start", "end", "replacement").withColumn("n", F.row_number().over(order) - 1)
    most = numbered.agg(F.max("n")).first()[0]
    states = states.withColumn("n_encoded", F.lit(0).cast("long"))
    names = ["doc_id", "text", "n_tokens", "lengths", "counts", "n_encoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                rows = b.slice(at, 500).to_pylist()
                for r in rows:
                    if not r["edits"]:
                        continue
                    tree, text = TokenTree(r["lengths"], r["counts"]), r["text"] or ""
                    for e in sorted(r["edits"], key=lambda e: e["n"]):
                        text, n = tree.edit(text, e["start"] or 0, e["end"] or 0, e["replacement"] or "", counter)
                        r["n_encoded"] += n
                    r["text"], r["n_tokens"] = text, tree.n_tokens
                    r["lengths"], r["counts"] = tree.flat()
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in names} for r in rows], pa.schema([b.schema.field(k) for k in names]))

    key = states.schema["doc_id"].dataType.simpleString()
    for k in range(0, (most + 1) if most is not None else 0, ROUND):
        some = numbered.filter((F.col("n") >= k) & (F.col("n") < k + ROUND)).groupBy("doc_id").agg(F.collect_list(F.struct("n", "start", "end", "replacement")).alias("edits"))
        states = states.join(some, "doc_id", "left").select(*names, "edits").mapInArrow(run, f"doc_id {key}, text string, n_tokens long, {_TREE}, n_encoded long")
    return states


def recount(docs: DataFrame, path: str) -> DataFrame:
    """For documents with their own ``edits`` (array of struct start, end, replacement; by position), in one pass: doc_id, n_tokens, n_pretokens, n_tokens_edited, n_encoded."""
    ranks = _ranks(docs.sparkSession, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out: list[list[int]] = [[], [], [], []]
                for text, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    text, done = text or "", 0
                    tree = TokenTree.of(text, counter)
                    out[0].append(tree.n_tokens)
                    out[1].append(sum(len(a) for a, _ in tree.leaves))
                    for e in edits or ():
                        text, n = tree.edit(text, e["start"] or 0, e["end"] or 0, e["replacement"] or "", counter)
                        done += n
                    out[2].append(tree.n_tokens)
                    out[3].append(done)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.int64()) for x in out)], ["doc_id", "n_tokens", "n_pretokens", "n_tokens_edited", "n_encoded"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", "edits").mapInArrow(run, f"doc_id {key}, n_tokens long, n_pretokens long, n_tokens_edited long, n_encoded long")


def sample_edits(docs: DataFrame) -> DataFrame:
    """``docs`` with three edits each: a text put in at a quarter, 20 characters after the middle turned round, the last 10 taken away."""
    n = F.char_length(F.coalesce("text", F.lit("")))
    edit = "struct<start: long, `end`: long, replacement: string>"
    put = F.struct((n / 4).cast("long"), (n / 4).cast("long"), F.lit(" (edited, twice) ")).cast(edit)
    half = (n / 2).cast("long")
    turned = F.struct(half, half + 20, F.reverse(F.substring("text", F.greatest(half + 1 - 17, F.lit(1)).cast("int"), F.lit(20)))).cast(edit)
    cut = F.struct(n.cast("long") - 10 + 17, n.cast("long") + 17, F.lit("")).cast(edit)
    return docs.select("doc_id", "text", F.array(put, turned, cut).alias("edits"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return recount(sample_edits(spark.read.parquet(f"{sf_dir}/documents.parquet")), public_tokenizers.path("byte_bpe_50k.tiktoken"))
