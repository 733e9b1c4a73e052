"""Operator 3: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Features: runs of 1, 2 and 3 characters of the lower-cased text in which whatever is not a letter counts as a blank (a run
needs a letter), hashed into ``DIMS`` buckets; the value is the run's share of the text's runs, times the inverse document
frequency of its bucket over *all* learning rows, times ``SCALE``. Weights are trained with follow-the-regularised-leader (proximal, with L1
and L2 penalties, so most weights are zero) on at most about ``PER_LANG`` documents of each language, chosen by a hash of doc_id. On
as many again (``CALIBRATE``) one temperature is fitted, so that scores are probabilities.

Prediction is one pass over whole texts without a shuffle: a text's score is a sum of table rows over its positions.
Results: null texts and texts without a letter are ``und`` with score 0; so is all if nothing can be learned from.
Ties go to the first language in alphabetical order. Repeated rows give repeated results; empty tables empty ones.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm._shared import byte_pieces, mix

DIMS = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 50.0
#: Learning rows of a language, and calibration rows of a language, about; the driver holds their n-gram counts.
PER_LANG = 500
CALIBRATE = 200
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.01
HELD_OUT = 2
BLOCK = 500_000


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case letter by code point of the basic plane; 0 for what is not a letter."""
    out = np.zeros(1 << 16, np.uint64)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters (0: none) and document offsets of a piece, in code points."""
    code = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
    begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    table = _letters()
    return table[np.minimum(code, 0xFFFF)] if len(code) and code.max() > 0xFFFF else table[code], begins[offsets]


def buckets(letters: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order: positions of the runs within one document that have a letter, and their buckets."""
    ends = np.zeros(len(letters) + 1, bool)
    ends[offsets] = True
    hashes, letter, inside = np.zeros(len(letters), np.uint64), np.zeros(len(letters), bool), np.ones(len(letters), bool)
    for k in range(max(ORDERS)):
        m = len(letters) - k
        if m <= 0:
            return
        if k:
            inside = inside[:m] & ~ends[k : m + k]
        hashes = (hashes[:m] + letters[k:]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1)
        letter = letter[:m] | (letters[k:] != 0)
        if k + 1 in ORDERS:
            at = np.flatnonzero(inside & letter)
            h = hashes[at]
            yield at, ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)).astype(np.int64)


def document_counts(column: pa.Array) -> Iterator[np.ndarray]:
    """Counts of each bucket, for each text."""
    for first, end, data, offsets in byte_pieces(column, BLOCK):
        letters, at = characters(data, offsets)
        by_order = list(buckets(letters, at))
        cuts = [np.searchsorted(p, at) for p, _ in by_order]
        for k in range(end - first):
            yield np.bincount(np.concatenate([b[c[k] : c[k + 1]] for c, (_, b) in zip(cuts, by_order, strict=True)] or [np.zeros(0, np.int64)]), minlength=DIMS)


def learning_rows(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out())


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == HELD_OUT, F.lit(False))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Of each bucket over all ``texts``, and the count of texts: summed where the texts are, added up by Spark."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMS + 1, np.int64), 0
        for b in batches:
            for counts in document_counts(b.column(0)):
                total[:-1] += counts > 0
                n += 1
        total[-1] = n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()  # DIMS + 1 rows at most
    out = np.zeros(DIMS + 1, np.int64)
    out[rows.bucket.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return out[:-1], int(out[-1])


class Model:
    """Languages, and for each bucket its weights times its inverse document frequency over the temperature."""

    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray):
        self.langs, self.table, self.bias = langs, table, bias

    def probabilities(self, column: pa.Array) -> Iterator[np.ndarray]:
        for first, end, data, offsets in byte_pieces(column, BLOCK):
            letters, at = characters(data, offsets)
            n = end - first
            sums, total = np.zeros((n, len(self.langs))), np.zeros(n)
            for lo in range(0, max(len(letters), 1), BLOCK):  # a text longer than a block is added up block by block, runs across included
                hi = min(lo + BLOCK + max(ORDERS) - 1, len(letters))
                part = np.clip(at, lo, hi) - lo
                for where, bucket in buckets(letters[lo:hi], part):
                    keep = int(np.searchsorted(where, BLOCK))
                    where, bucket = where[:keep], bucket[:keep]
                    cut = np.searchsorted(where, part)
                    have = np.flatnonzero(cut[1:] > cut[:-1])
                    if len(have):
                        total[have] += np.diff(cut)[have]
                        for k in range(len(self.langs)):
                            sums[have, k] += np.add.reduceat(self.table[k][bucket], cut[:-1][have])
            z = sums * (SCALE / np.maximum(total, 1))[:, None] + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            yield from z / z.sum(axis=1, keepdims=True)


def train(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIMS, classes) and bias by follow-the-regularised-leader over sparse rows (buckets, values)."""
    z, n = np.zeros((DIMS + 1, n_classes)), np.zeros((DIMS + 1, n_classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= L1, 0.0, -(zz - np.sign(zz) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    order = np.argsort(mix(np.arange(len(x), dtype=np.uint64)))
    for _ in range(EPOCHS):
        for i in order:
            at, value = np.append(x[i][0], DIMS), np.append(x[i][1], 1.0)
            w = weights(at)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            g = value[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(DIMS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden sections over its logarithm."""

    def loss(t: float) -> float:
        z = logits / np.exp(t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

    low, high, g = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(docs: DataFrame, per_lang: int = PER_LANG, calibrate: int = CALIBRATE) -> Model | None:
    """The model learned from rows that aren't held out; None if there are none."""
    rows = learning_rows(docs)
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    langs = sorted(sizes)
    df, n = document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    million = 1_000_000
    u = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(million))
    share = F.coalesce(*[F.when(F.col("lang") == g, F.lit(min(million, -(-million * (per_lang + calibrate) // k)))) for g, k in sizes.items()])
    split = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(per_lang + calibrate)) < per_lang
    sample = rows.filter(u < share).select("doc_id", "text", "lang", split.alias("learn"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, values = [], []
            for counts in document_counts(b.column(1)):
                at.append(np.flatnonzero(counts).astype(np.int32))
                values.append((counts[at[-1]] / max(counts.sum(), 1)).astype(np.float32))
            cut = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in at])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(np.concatenate(v) if v else [], t)) for v, t in ((at, pa.int32()), (values, pa.float32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *lists], ["doc_id", "lang", "learn", "at", "value"])

    key = docs.schema["doc_id"].dataType.simpleString()
    got = sample.mapInArrow(run, f"doc_id {key}, lang string, learn boolean, at array<int>, value array<float>").toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("lang", "ascending")])
    y = np.array([langs.index(g) for g in got["lang"].to_pylist()], np.int64)
    learn = np.array(got["learn"].to_pylist(), bool)
    if not learn.any() or learn.all():  # too few rows to set some aside
        learn = np.ones(len(y), bool)
    at_list, value_list = got["at"].combine_chunks(), got["value"].combine_chunks()
    x = []
    for i in range(len(y)):
        at = np.asarray(at_list[i].values)
        x.append((at, np.asarray(value_list[i].values) * idf[at] * SCALE))
    chosen = np.flatnonzero(learn)
    w, bias = train([x[i] for i in chosen], y[chosen], len(langs))
    rest = np.flatnonzero(~learn)
    t = temperature(np.array([x[i][1] @ w[x[i][0]] + bias for i in rest]), y[rest]) if len(rest) else 1.0
    return Model(langs, np.ascontiguousarray((w * idf[:, None] / t).T.astype(np.float32)), bias / t)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS rows by languages

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            lang, score = [], []
            texts = b.column(2)
            rows = m.probabilities(texts) if m else iter([None] * b.num_rows)
            for i, p in enumerate(rows):
                text = texts[i].as_py() if p is not None else None
                if text is None or not any(map(str.isalpha, text)):
                    lang.append("und")
                    score.append(0.0)
                else:
                    k = int(p.argmax())
                    lang.append(m.langs[k])
                    score.append(float(min(p[k], 1.0)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, f"doc_id {key}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, per_lang: int = PER_LANG, calibrate: int = CALIBRATE) -> DataFrame:
    return predict(docs, fit(docs, per_lang, calibrate))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep(docs: DataFrame, model: Model | None, min_score: float) -> DataFrame:
    """The documents, all columns, that have a letter and whose language is predicted with ``min_score`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(at)
            sure = [bool(p.max() >= min_score) for p in m.probabilities(texts)] if m else [False] * b.num_rows
            yield b.filter(pa.array([s and any(map(str.isalpha, texts[i].as_py() or "")) for i, s in enumerate(sure)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
