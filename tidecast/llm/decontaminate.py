"""Operator 4: benchmark decontamination by SimHash windows, multi-index Hamming blocks and exact verification.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased (A-Z and the accented Latin-1 capitals). Items
and windows are multisets of runs of five words (of fewer: the whole as one), each weighted by log(1 + items / items that have it).

A window has as many words as an item and may begin at any word. Its SimHash has 128 bits in 16 blocks; the index holds, for each
item length, each block's value and all values one bit away, so any item within ``RADIUS`` = 31 bits of a window is found (of 31
differing bits, some of 16 blocks has at most one). A pair at the threshold lies within it with all but about 0.05 % probability, equal texts always.
What is found is verified: sum of least over sum of greatest weighted counts, ``SIMILARITY`` or more. Windows without any run of an item
have similarity 0 with all of them, and get no fingerprint. Items of fewer than five words are one run, so their windows are equal or have similarity 0:
they are looked up among all runs of as many words of a document.

The benchmark is taken in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_CHARS`` characters, whose index is broadcast; every
document meets every block. Items and how many of them have a run are counted over the whole benchmark; only runs of two or more items go with the index. Documents aren't shuffled. Items without words match nothing; a document shorter than an item is one window.
Results: ``matches`` has a row for each document and item (the most similar window, the first of equals). Null texts match nothing. Rows of
repeated items or documents repeat. ``clean`` keeps all columns of documents without a match, whatever their names.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from tidecast.llm._shared import byte_codes, byte_pieces, mix, ngram_hashes, span_hashes, word_spans

WIDTH = 5
SIMILARITY = 0.8
BLOCKS, BITS = 16, 8
RADIUS = 31
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 4_000_000

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_CODES = byte_codes(fold=True)
_SEEDS = mix(np.arange(1, 3, dtype=np.uint64))


def fold_latin(data: np.ndarray) -> np.ndarray:
    """Capitals of U+00C0 to U+00DE as small letters."""
    second = (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97) & (data[:-1] == 0xC3)
    if not second.any():
        return data
    out = data.copy()
    out[1:][second] += 0x20
    return out


def shingles(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece: first row, cuts of shingles by row, shingle hashes, first words (counted in the row), words by row."""
    for first, end, data, offsets in byte_pieces(column):
        data = fold_latin(data)
        starts, ends, docs = word_spans(data, offsets, _BREAK)
        words = span_hashes(data, starts, ends, _CODES)
        cut = np.searchsorted(docs, np.arange(end - first + 1))
        grams, at = ngram_hashes(words, docs, WIDTH)
        counts = np.diff(cut)
        short = np.flatnonzero((counts > 0) & (counts < WIDTH))
        if len(short):  # the whole text as one shingle
            extra = np.array([mix(np.bitwise_xor.reduce(mix(words[cut[k] : cut[k + 1]] + np.arange(counts[k], dtype=np.uint64)))[None])[0] for k in short], np.uint64)
            at, grams = np.concatenate([at, cut[short]]), np.concatenate([grams, extra])
            order = np.argsort(at, kind="stable")
            at, grams = at[order], grams[order]
        doc = docs[at]
        yield first, np.searchsorted(doc, np.arange(end - first + 1)), grams, at - cut[doc], counts


def short_runs(column: pa.Array, widths: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece and width below ``WIDTH``: words of a run, hashes of all runs (as ``shingles`` has for a whole text), their rows, first words."""
    for first, end, data, offsets in byte_pieces(column):
        data = fold_latin(data)
        starts, ends, docs = word_spans(data, offsets, _BREAK)
        words = span_hashes(data, starts, ends, _CODES)
        cut = np.searchsorted(docs, np.arange(end - first + 1))
        for width in widths:
            n = len(words) - width + 1
            if n > 0:
                grams = mix(np.bitwise_xor.reduce([mix(words[k : k + n] + np.uint64(k)) for k in range(width)]))
                ok = docs[:n] == docs[width - 1 :]
                yield width, grams[ok], first + docs[:n][ok], (np.arange(n) - cut[docs[:n]])[ok]


def _signs(grams: np.ndarray) -> np.ndarray:
    """The 128 bits of each hash, as 1 and -1."""
    both = mix(grams[:, None] ^ _SEEDS[None, :])
    return np.unpackbits(both.view(np.uint8), axis=1).astype(np.float64) * 2 - 1


def _bits(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 1e-9, axis=-1)


class Index:
    """A block of items: shingles with their items and weights, and fingerprints by length and block value.

    ``known``: items of the whole benchmark, and of shingles that two or more of them have, how many do; by default those of the block."""

    def __init__(self, ids: list, texts: list[str | None], known: tuple[int, dict[int, int]] | None = None):
        self.ids, self.items, self.length = [], [], []
        for first, cut, grams, _, counts in shingles(pa.array(texts, pa.string())):
            for k in range(len(counts)):
                if counts[k]:
                    self.ids.append(ids[first + k])
                    self.items.append(Counter(grams[cut[k] : cut[k + 1]].tolist()))
                    self.length.append(int(counts[k]))
        n, often = known or (len(self.items), Counter(g for item in self.items for g in item))
        self.rare = float(np.log(1 + n)) or 1.0
        self.weight = {g: float(np.log(1 + n / often.get(g, 1))) for g in {*often, *(g for item in self.items for g in item)}}
        self.total = [sum(self.weight[g] * c for g, c in item.items()) for item in self.items]
        self.short: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if self.length[i] < WIDTH:
                self.short[self.length[i], next(iter(item))].append(i)
        self.widths = sorted({width for width, _ in self.short})
        self.short_keys = {width: np.array(sorted(g for w, g in self.short if w == width), np.uint64) for width in self.widths}
        self.keys = np.array(sorted({g for i, item in enumerate(self.items) if self.length[i] >= WIDTH for g in item}), np.uint64)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.lengths_of: dict[int, set[int]] = defaultdict(set)
        self.prints = np.zeros((len(self.items), BLOCKS), np.uint8)
        self.found: dict[tuple[int, int, int], list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if self.length[i] < WIDTH:
                continue
            grams = np.array(list(item), np.uint64)
            weights = np.array([self.weight[g] * item[g] for g in grams.tolist()])
            self.prints[i] = _bits(weights @ _signs(grams))
            for g in item:
                self.lengths_of[g].add(self.length[i])
            for b in range(BLOCKS):
                for flip in (0, *(1 << k for k in range(BITS))):
                    self.found[self.length[i], b, int(self.prints[i, b]) ^ flip].append(i)

    def candidates(self, length: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) for all within the radius."""
        for w, code in enumerate(prints):
            near = set()
            for b, value in enumerate(code.tolist()):
                near.update(self.found.get((length, b, value), ()))
            for i in near:
                if int(np.bitwise_count(code ^ self.prints[i]).sum()) <= RADIUS:
                    yield w, i

    def similarity(self, window: Counter, item: int) -> float:
        own = self.items[item]
        common = sum(self.weight[g] * min(c, window[g]) for g, c in own.items() if g in window)
        whole = sum(self.weight.get(g, self.rare) * c for g, c in window.items())
        return common / (self.total[item] + whole - common)

    def search(self, grams: np.ndarray, at: np.ndarray, words: int) -> dict[int, tuple[float, int, int]]:
        """Item to (similarity, first word, words) of one document, given its shingles."""
        out: dict[int, tuple[float, int, int]] = {}
        hit = np.flatnonzero(self.sieve[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(hit) and len(self.keys):
            hit = hit[self.keys[np.minimum(np.searchsorted(self.keys, grams[hit]), len(self.keys) - 1)] == grams[hit]]
        begins: dict[int, list[np.ndarray]] = defaultdict(list)
        for h in hit.tolist():
            for length in self.lengths_of[int(grams[h])]:
                size = max(min(length, words) - WIDTH + 1, 1)  # shingles of a window
                begins[length].append(np.arange(max(0, h - size + 1), min(h, len(grams) - size) + 1))
        for length, parts in begins.items():
            size = max(min(length, words) - WIDTH + 1, 1)
            starts = np.unique(np.concatenate(parts))
            for part in np.split(starts, np.flatnonzero(np.diff(starts) > size) + 1):  # windows near each other
                for lo in range(0, len(part), 2000):
                    some = part[lo : lo + 2000]
                    base = int(some[0])
                    inside = grams[base : int(some[-1]) + size]
                    weights = np.array([self.weight.get(g, self.rare) for g in inside.tolist()])
                    sums = np.concatenate([np.zeros((1, 128)), np.cumsum(weights[:, None] * _signs(inside), axis=0)])
                    for w, i in self.candidates(length, _bits(sums[some - base + size] - sums[some - base])):
                        s = int(some[w])
                        value = self.similarity(Counter(grams[s : s + size].tolist()), i)
                        if value >= SIMILARITY and (i not in out or value > out[i][0]):
                            out[i] = (value, int(at[s]), min(length, words))
        return out


def frequencies(items: DataFrame) -> tuple[int, dict[int, int]]:
    """Items with words, and of shingles that two or more items have, how many do."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, cut, grams, _, counts in shingles(b.column(0)):
                own = [np.unique(grams[cut[k] : cut[k + 1]]) for k in range(len(counts)) if counts[k]]
                values = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([*[None] * len(own), *values.tolist()], pa.int64())], ["gram"])  # null for each item

    rows = items.select("text").mapInArrow(run, "gram long").groupBy("gram").count().filter("count > 1 or gram is null")
    found = {g: k for g, k in rows.toLocalIterator()}
    n = found.pop(None, 0)
    return n, {g % (1 << 64): k for g, k in found.items()}


def _blocks(spark: SparkSession, items: DataFrame) -> Iterator:
    """Broadcast indexes of bounded blocks of items."""
    ids, texts, size = [], [], 0
    counts = frequencies(items)
    for r in items.select("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or size + len(r[1] or "") > BLOCK_CHARS):
            yield spark.sparkContext.broadcast(Index(ids, texts, counts))
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(r[1])
        size += len(r[1] or "")
    yield spark.sparkContext.broadcast(Index(ids, texts, counts))


def _searched(index: Index, column: pa.Array) -> Iterator[tuple[int, dict]]:
    for first, cut, grams, at, counts in shingles(column):
        hit = np.flatnonzero(index.sieve[(grams & np.uint64((1 << 22) - 1)).astype(np.int64)])
        for k in np.unique(np.searchsorted(cut, hit, side="right") - 1).tolist():
            part = slice(cut[k], cut[k + 1])
            if found := index.search(grams[part], at[part], int(counts[k])):
                yield first + k, found
    if index.widths:
        for width, grams, rows, at in short_runs(column, index.widths):
            found = {}
            for h in np.flatnonzero(np.isin(grams, index.short_keys[width])).tolist():
                for i in index.short[width, int(grams[h])]:
                    found.setdefault(int(rows[h]), {}).setdefault(i, (1.0, int(at[h]), width))
            yield from found.items()


def matches(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words."""
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType
    names = ["doc_id", "item_id", "similarity", "first_word", "n_words"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, similarity double, first_word long, n_words long"

    def against(shared) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in batches:
                rows = [(k, index.ids[i], *v) for k, found in _searched(index, b.column(1)) for i, v in found.items()]
                columns = [b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))]
                columns += [pa.array([r[k] for r in rows], t) for k, t in ((1, to_arrow_type(id_type)), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names)

        return docs.select("doc_id", "text").mapInArrow(run, schema)

    out = None
    for shared in _blocks(spark, items.select("item_id", "text")):
        out = against(shared) if out is None else out.union(against(shared))
    return out


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a match, all columns."""
    at = docs.columns.index("text")
    for shared in _blocks(docs.sparkSession, items):

        def run(batches: Iterable[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[k for k, _ in _searched(shared.value, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
