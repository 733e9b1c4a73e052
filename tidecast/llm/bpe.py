"""Operator 1: byte-pair encoding and decoding by prefix-sharing trie traversal.

For a vocabulary made by merges, the encoding of a word's prefix is fixed by one token, the last: among the tokens
that end the prefix there is exactly one that is compatible with the last token of what stands before it, and what
stands before is again a prefix. So the distinct words of a batch form a trie (kept as its depth-first order, the
sorted words, which needs no nodes); the walk hands the last tokens of the path down to each node, computes the
node's own, and all words below share them. Two neighbours are
compatible if merging their joint symbols by rank gives just these two tokens (remembered for each pair).

Results: ``encode`` adds ``ids array<int>`` (null text: empty), ``decode`` turns ids into text, ``op1_bpe`` returns the
digests. Texts with no token have no ids. Null ids decode to the empty text. Repeated rows give repeated results;
further columns are kept, those named like a result are replaced. Empty tables give empty tables.
One pass over the rows, without a shuffle; memory is bounded by the batch and by ``CACHE`` remembered words.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Words that a task remembers; at that many it starts anew.
CACHE = 300_000
#: Characters of text that are encoded together, so that working lists stay small.
STEP = 1_000_000
# The white space of the tokenizer's patterns, and its pre-token pattern.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_WORDS = regex.compile("'s|'t|'re|'ve|'m|'ll|'d|\\p{L}+|\\p{N}|[^" + _SPACE + "\\p{L}\\p{N}]+")


# What the tokenizer counts as letters and numbers (first, last) beyond Unicode 15.1, and small letters that it knows beyond it (first, last, distance).
_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
_SMALL = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC),
    (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B),
)
# The small sigma in every place: lower case goes letter by letter, without a final form.
_LOWER = {0x3A3: 0x3C3} | {c: c + d for a, b, d in _SMALL for c in range(a, b + 1)}


#: Beyond Latin letters and common marks; within them all versions of Unicode agree.
_UNUSUAL = re.compile("[^\x00-\u024f\u2000-\u206f\u20ac]")


def _class(marked: np.ndarray) -> str:
    """A pattern's character class of the code points at which ``marked`` holds."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return "".join(f"\\U{lo:08X}-\\U{hi - 1:08X}" for lo, hi in edges.reshape(-1, 2).tolist())


@functools.lru_cache(maxsize=1)
def _exact_words() -> tuple[regex.Pattern, regex.Pattern]:
    """A pattern of characters that this interpreter's patterns class otherwise than the tokenizer, and the word pattern for texts that have one."""
    whole = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "\0" for c in range(0x110000))
    kinds = np.frombuffer("".join(map(unicodedata.category, whole)).encode(), "S1")[::2]
    disputed = np.zeros(len(whole), bool)
    classes = []
    for kind, more in (("L", _LETTERS), ("N", _NUMBERS)):
        true, own = kinds == kind.encode(), np.zeros(len(whole), bool)
        for lo, hi in more:
            true[lo : hi + 1] = True
        for m in regex.finditer(rf"\p{{{kind}}}+", whole):
            own[m.start() : m.end()] = True
        disputed |= true != own
        classes.append(_class(true))
    a, b = classes
    return regex.compile(f"[{_class(disputed)}]" if disputed.any() else r"(?!)"), regex.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{a}]+|[{b}]|[^{_SPACE}{a}{b}]+")


def _byte_alphabet() -> list[str]:
    """The letter that stands for each byte: printable bytes themselves, the others from U+0100 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A lower-casing BPE vocabulary with word ends, from a tokenizers JSON file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.rank = {tuple(m): i for i, m in enumerate(model["merges"])}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        self.text = [""] * (1 + max([*self.ids.values(), *self.added.values()]))
        for t, i in [*self.ids.items(), *self.added.items()]:
            self.text[i] = t
        self.table = {b: c for b, c in enumerate(_byte_alphabet())}
        self.bytes = [i.to_bytes(4, "little") for i in range(len(self.text))]
        self.pairs: list[dict[int, bool]] = [{} for _ in self.text]  # by the second token
        self.n_pairs = 0
        self.inner: dict[str, int] = {}  # tokens by their letters: inside a word, and at its end
        self.last: dict[str, int] = {}
        for t in self.ids:
            body, final = (t[: -len(self.end)], True) if self.end and t.endswith(self.end) else (t, False)
            if body and self.merge(self.symbols(t)) == [t]:  # a token that no merge sequence reaches never occurs
                (self.last if final or not self.end else self.inner)[body] = self.ids[t]
        if not self.end:
            self.inner = self.last
        self.heads = {t[:i] for t in [*self.inner, *self.last] for i in range(1, len(t) + 1)}
        self.follow: dict[str, dict[str, str]] = {"": {}}
        self.inner_at: dict[str, list[tuple[int, int]]] = {}
        self.last_at: dict[str, list[tuple[int, int]]] = {}
        self.cache: dict[str, bytes] = {}

    def symbols(self, t: str) -> list[str]:
        if self.end and t.endswith(self.end):
            body = t[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(t)

    def merge(self, parts: list[str]) -> list[str]:
        """Merging by rank, the definition; only for pairs and for single tokens."""
        while len(parts) > 1:
            best, at = min((self.rank.get((a, b), 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 30:
                break
            parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens with these ids stay as they are side by side."""
        x, y = self.text[a], self.text[b]
        if self.n_pairs > 4 * CACHE:
            self.n_pairs = 0
            for known in self.pairs:
                known.clear()
        self.n_pairs += 1
        out = self.pairs[b][a] = self.merge(self.symbols(x) + self.symbols(y)) == [x, y]
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, as little-endian bytes, by one walk over their trie.

        Sorted words are their trie in depth-first order: two neighbours share the path of their common prefix. ``path``
        is the walk's stack, with the suffix state, the last token and the ids up to it for each prefix."""
        spelt = sorted((w.encode().decode("latin-1").translate(self.table), w) for w in words)
        out: dict[str, bytes] = {}
        states, lasts, codes = [""], [-1], [b""]  # of each prefix on the path; codes: ids up to the last token
        before = ""
        follow, inner, final, pairs = self.follow, self.inner_at, self.last_at, self.pairs
        for letters, w in spelt:
            depth = 0
            for x, y in zip(before, letters, strict=False):
                if x != y:
                    break
                depth += 1
            depth = min(depth, len(letters) - 1, len(states) - 1)
            del states[depth + 1 :], lasts[depth + 1 :], codes[depth + 1 :]
            before = letters
            end = len(letters) - 1
            while True:
                state = follow[states[depth]].get(letters[depth]) or self.go(states[depth], letters[depth])
                depth += 1
                for token, size in (inner if depth <= end else final)[state]:
                    at = depth - size
                    if at == 0:
                        break
                    if (ok := pairs[token].get(lasts[at])) is None:
                        ok = self.fits(lasts[at], token)
                    if ok:
                        break
                else:
                    raise ValueError("the vocabulary does not cover every byte")
                if depth > end:
                    out[w] = codes[at] + self.bytes[token]
                    break
                states.append(state)
                lasts.append(token)
                codes.append(codes[at] + self.bytes[token])
        return out

    def go(self, state: str, letter: str) -> str:
        """The longest end of ``state + letter`` with which some token begins; remembered, one for each such beginning."""
        new = state + letter
        while new not in self.heads:
            new = new[1:]
        self.follow[state][letter] = new
        if new not in self.follow:
            self.follow[new] = {}
            ends = [new[i:] for i in range(len(new))]
            self.inner_at[new] = [(self.inner[e], len(e)) for e in ends if e in self.inner]
            self.last_at[new] = [(self.last[e], len(e)) for e in ends if e in self.last]
        return new

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _WORDS.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        if not _UNUSUAL.search(text):
            return _WORDS.findall(text.lower())
        text = text.translate(_LOWER).lower()
        disputed, exact = _exact_words()
        return (exact if disputed.search(text) else _WORDS).findall(text)

    def pieces(self, text: str) -> Iterator[list[str] | int]:
        """Words, and ids of the special tokens whose strings stand in the text."""
        for part in self.split.split(text) if self.split and "<|" in text else [text]:
            yield self.added[part] if part in self.added else self.words(part)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end] or "") <= STEP):
                size += len(texts[end] or "")
                end += 1
            parts = [list(self.pieces(t or "")) for t in texts[at:end]]
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = {w for p in parts for x in p if not isinstance(x, int) for w in x} - self.cache.keys()
            self.cache.update(self.encode_words(new))
            get = self.cache.__getitem__
            out += [b"".join(x.to_bytes(4, "little") if isinstance(x, int) else b"".join(map(get, x)) for x in p) for p in parts]
            at = end
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """The vocabulary names no decoder: the token strings, one space between."""
        return " ".join(map(self.text.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def _model(spec: str) -> WordBpe:
    return WordBpe(spec)


def _spec(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:  # a vocabulary has a fixed size
        return spark.sparkContext.broadcast(f.read())


def _schema(df: DataFrame, more: str) -> str:
    names = {x.split()[0].lower() for x in more.split(", ")}
    kept = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema if f.name.lower() not in names]
    return ", ".join([*kept, more])


def encode(spark: SparkSession, docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ``ids array<int>``."""
    spec = _spec(spark, path)
    kept = [c for c in docs.columns if c.lower() != "ids"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        for b in batches:
            codes = bpe.encode_batch(b.column(b.schema.get_field_index(text)).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(codes), "<i4")))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), ids], [*kept, "ids"])

    return docs.mapInArrow(run, _schema(docs, "ids array<int>"))


def decode(spark: SparkSession, docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``docs`` with ``decoded string``."""
    spec = _spec(spark, path)
    kept = [c for c in docs.columns if c.lower() != "decoded"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        for b in batches:
            text = pa.array([bpe.decode(x or ()) for x in b.column(b.schema.get_field_index(ids)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), text], [*kept, "decoded"])

    return docs.mapInArrow(run, _schema(docs, "decoded string"))


def round_trip(spark: SparkSession, docs: DataFrame, path: str) -> DataFrame:
    """Encoding and decoding of each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spec = _spec(spark, path)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _model(spec.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 500):
                codes = bpe.encode_batch(texts[at : at + 500])
                texts[at : at + 500] = [None] * len(codes)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, 500),
                        pa.array([len(c) // 4 for c in codes], pa.int64()),
                        pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                        pa.array([hashlib.sha256(bpe.decode(np.frombuffer(c, "<u4").tolist()).encode()).hexdigest() for c in codes], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
