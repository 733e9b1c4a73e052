"""Operator 9: secret scans by a character convolutional network over candidates and their context.

Candidates are (a) the findings of three fixed patterns, which always stay, and (b) what those leave of all runs of ``A-Za-z0-9+/_.=-``, where it has
16 characters or more, so a key that only touches a finding is read; a hexadecimal or access finding that goes on in further letters or digits is read together with these. Each candidate with the characters around it goes through a
convolutional network in numpy: embedded characters, one layer of filters of width 5, the greatest value of each filter over
the candidate and over its context, and a logistic output. A candidate of more than ``BODY`` characters is read in windows of so many, which
overlap by half, each with the candidate's context; its score is the greatest of them. Size and distinct characters are those of the whole candidate. It is trained on labelled findings: a table of (text, start, end, is_secret),
or by default the findings that ``labelled_findings`` makes from a seed: keys, tokens and passwords of many forms, bare and assigned; against them long words, paths, dates, versions, mail hosts, rules, identifiers,
and digests and serial numbers that look like keys but are named as what they are. Of digests that nothing names some are labelled secret and some not, so no score is certain.
Seven tenths of the findings train, a tenth and a half fits a temperature, so that scores are probabilities, and the rest gives the
threshold: the greatest score that keeps a recall of ``RECALL`` on its secrets. Candidates (b) at or above it are findings of kind ``model``.

Offsets are code points, ends exclusive, over the whole text. Texts that are null, empty or clean have no spans. Equal texts give equal spans; spans that begin at one place are ordered by kind; repeated rows
repeat; very long texts and candidates are read whole, in blocks; an empty table gives an empty table; further columns are not kept by scans, whatever their names, and all kept by ``redact``.
Labelled findings with a null are left out. One pass over the rows without a shuffle; the model (a few thousand numbers) is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The base patterns, the least lengths (of group 2; of the match), and the kinds in their order.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the runs of 16 or more among all runs
KINDS = ("assign", "access", "hex", "model")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18

_ASSIGN, _ACCESS, _HEX = re.compile(ASSIGN), re.compile(ACCESS), re.compile(HEX)
_WORD = re.compile(r"password|passwd|secret|token|api_?key", re.I | re.A)
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
LEAST = 16  # characters of what the patterns leave of a run, for it to be a candidate

BODY, AROUND = 48, 16  # characters of a candidate (of a window, if it is longer) and of the context on either side
WIDTH, FILTERS, EMBED = 5, 24, 8
RECALL = 0.95
EPOCHS = 7
TEMPERATURES = np.geomspace(0.1, 10, 81)
#: Labelled findings that a model is fitted on, at most.
FINDINGS = 10_000


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns, by start, then kind in the order of ``KINDS``."""
    out = []
    if _WORD.search(text):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """What the patterns leave of the runs of 16 or more, where that is 16 or more itself; and letters and digits that go on from a hexadecimal or access finding, with it."""
    out, k, live = [], 0, []  # base spans are in order of their starts; ``live``: those that may reach into this run
    for m in _RUN.finditer(text):
        start, end = m.span()
        while k < len(base) and base[k][0] < end:
            live.append(base[k])
            k += 1
        live = [x for x in live if x[1] > start]
        taken, assigned, access, low, high = [], 0, (0, 0), 0, 0
        for s, e, kind in live:
            if kind == "assign":
                assigned = max(assigned, e)
            else:
                if kind == "access":
                    access = (s, e)
                if not low <= s < high:  # else the letters and digits around it are those of the finding before
                    low, high = max(s, start), min(e, end)
                    while low > start and text[low - 1] in _LETTERS:
                        low -= 1
                    while high < end and text[high] in _LETTERS:
                        high += 1
                if (low, high) != (s, e) and assigned < high and not (access[0] <= low and high <= access[1]):
                    out.append((low, high))
                s, e = low, high
            taken.append((s, e))
        at = start
        for s, e in sorted(taken):
            if s - at >= LEAST:
                out.append((at, s))
            at = max(at, e)
        if end - at >= LEAST:
            out.append((at, end))
    return sorted(set(out))


# ---------------------------------------------------------------- network


def windows(text: str, start: int, end: int) -> list[np.ndarray]:
    """Of each window of a candidate: codes 0 to 97 of the context before, the window and the context after, then size and distinct characters of the candidate."""
    around, after = text[max(0, start - AROUND) : start].rjust(AROUND, "\0"), text[end : end + AROUND].ljust(AROUND, "\0")
    counts = [end - start, len(set(text[start:end]))]
    out = []
    for at in [*range(start, end - BODY, BODY // 2), max(start, end - BODY)]:
        parts = around + text[at : min(at + BODY, end)].ljust(BODY, "\0") + after
        code = np.frombuffer(parts.encode("utf-32-le"), "<u4").astype(np.int64)
        code = np.where(code == 0, 0, np.where((code >= 32) & (code < 127), code - 31, np.where(code < 32, 1, 97)))
        out.append(np.concatenate([code, counts]))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """The first window of a candidate."""
    return windows(text, start, end)[0]


class Network:
    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p = {
            "embed": r.normal(0, 0.5, (98, EMBED)),
            "filters": r.normal(0, 0.2, (WIDTH * EMBED, FILTERS)),
            "shift": np.zeros(FILTERS),
            "out": r.normal(0, 0.2, 2 * FILTERS + 2),
            "bias": np.zeros(1),
        }
        self.temperature, self.threshold = 1.0, 0.5

    def _forward(self, x: np.ndarray) -> tuple:
        x, counts = x[:, :-2], x[:, -2:]
        e = self.p["embed"][x]
        n, length = x.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, WIDTH, axis=1).transpose(0, 1, 3, 2).reshape(n, length - WIDTH + 1, WIDTH * EMBED)
        a = np.maximum(cols @ self.p["filters"] + self.p["shift"], 0)
        body = slice(AROUND, AROUND + BODY - WIDTH + 1)
        around = np.r_[0 : AROUND - 2, AROUND + BODY - 2 : length - WIDTH + 1]
        best_body, best_around = a[:, body].argmax(axis=1) + AROUND, around[a[:, around].argmax(axis=1)]
        k = np.arange(FILTERS)
        pooled = np.concatenate([a[np.arange(n)[:, None], best_body, k], a[np.arange(n)[:, None], best_around, k], np.log2(1 + counts / BODY)], axis=1)
        return cols, best_body, best_around, pooled, pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 256])[-1] for i in range(0, len(x), 256)] or [np.zeros(0)])

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(x) / self.temperature))

    def loss(self, x: np.ndarray, y: np.ndarray) -> float:
        z = self.logits(x)
        return float(np.logaddexp(0, -np.where(y == 1, z, -z)).mean())

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean loss, by backward pass."""
        cols, body, around, pooled, z = self._forward(x)
        n = np.arange(len(x))
        d = (1 / (1 + np.exp(-z)) - y) / len(x)
        g = {"out": pooled.T @ d, "bias": np.array([d.sum()]), "embed": np.zeros_like(self.p["embed"]), "filters": np.zeros_like(self.p["filters"])}
        dp = d[:, None] * self.p["out"][None, : 2 * FILTERS] * (pooled[:, : 2 * FILTERS] > 0)
        g["shift"] = dp[:, :FILTERS].sum(axis=0) + dp[:, FILTERS:].sum(axis=0)
        for best, part in ((body, dp[:, :FILTERS]), (around, dp[:, FILTERS:])):
            picked = cols[n[:, None], best]  # rows, filters, inputs
            g["filters"] += np.einsum("nf,nfi->if", part, picked)
            back = (part[:, :, None] * self.p["filters"].T[None]).reshape(len(x), FILTERS, WIDTH, EMBED)
            np.add.at(g["embed"], x[n[:, None, None], best[:, :, None] + np.arange(WIDTH)], back)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 7) -> None:
        """Adam, with a rate that falls to a tenth."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(x))
            now = rate * 0.1 ** (epoch / max(epochs - 1, 1))
            for at in range(0, len(x), 64):
                rows = order[at : at + 64]
                g = self.gradients(x[rows], y[rows])
                step += 1
                for k in self.p:
                    m[k] += 0.1 * (g[k] - m[k])
                    v2[k] += 0.001 * (g[k] ** 2 - v2[k])
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)

    def fit_temperature(self, x: np.ndarray, y: np.ndarray) -> None:
        z = self.logits(x)
        self.temperature = min((float(np.logaddexp(0, -np.where(y == 1, z, -z) / t).mean()), float(t)) for t in TEMPERATURES)[1]

    def set_threshold(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        secret = np.sort(self.scores(x)[y == 1])
        if len(secret):
            self.threshold = float(secret[int((1 - recall) * len(secret))])


# ---------------------------------------------------------------- labelled findings

_HEXES, _UPPER, _LOWER, _DIGITS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _UPPER + _LOWER + _DIGITS
_PLAIN = str.maketrans("éèüöñó", "eeuono")
#: Frequent parts of English, German, French and Spanish words.
_SYLLABLES = (
    "the th he er an re on in ed ou ti es or at to of and is it ha hi wh sh ly bl ble nd st ing tion ent ver ge ein sch ich cht zu tz pf be de die und keit heit lich ung en el la le os as ar al "
    "ción que qu ment eau oi eux ch ier pa vi tre ai é è ü ö ñ co ro ma ni so ta ra"
).split()


def labelled_findings(n: int = FINDINGS, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """``n`` findings (text, start, end, is_secret), half of them secrets, made from a seed."""
    r = np.random.default_rng(seed)
    some = lambda letters, low, high: "".join(r.choice(list(letters), int(r.integers(low, high + 1))))
    one = lambda *x: x[int(r.integers(len(x)))]
    word = lambda: "".join(_SYLLABLES[int(r.integers(len(_SYLLABLES)))] for _ in range(int(r.integers(1, 6))))
    plain = lambda: word().translate(_PLAIN)
    words = lambda k: " ".join(word() for _ in range(k))
    digits = lambda low, high: some(_DIGITS, low, high)
    key = lambda: one(
        lambda: some(_ALNUM + "+/", 20, 44) + one("", "=", "=="),
        lambda: one("ghp_", "sk-", "xoxb-", "pk_live_", "glpat-", "AIza", "SG.") + some(_ALNUM + "_-", 20, 40),
        lambda: "AKIA" + some(_UPPER + _DIGITS, 12, 16),
        lambda: some(_ALNUM, 20, 40),
        lambda: some(_UPPER + _LOWER, 24, 40),
        lambda: some(_HEXES, 32, 64),
        lambda: f"eyJ{some(_ALNUM, 16, 24)}.eyJ{some(_ALNUM, 20, 30)}.{some(_ALNUM + '_-', 20, 40)}",
    )()
    named = lambda: one("password", "passwd", "secret", "token", "api_key", "apikey", "Token", "PASSWORD", "API_KEY") + one("", '"') + one("=", " = ", ": ", ":", " := ") + one("", '"', "'")
    digest = lambda: some(_HEXES, 40, 40) if r.random() < 0.5 else some(_HEXES, 32, 64)
    out = []
    for i in range(n):
        before, after = words(int(r.integers(1, 4))) + " ", one('"', " ", ". ", "\n", ", ", "' ", ")") + words(2)
        if i % 2:
            kind, secret = int(r.integers(10)), 1
            if kind < 3:  # assigned: the name belongs to the finding
                value = named() + one(key, key, lambda: some(_ALNUM + "._-", 12, 20), lambda: plain() + digits(2, 4) + one("", "-", ".") + plain() + digits(2, 4))()
            elif kind < 4:
                value = digest()
            else:
                before += one("", one('key = "', "Authorization: Bearer ", "auth_token: ", "export KEY=", "client_secret=", "credentials ", "access key ", "token "), named(), words(1) + " ")
                value = key() if r.random() < 0.8 else digest()
        elif r.random() < 0.12:  # looks like a key, and is named as something else, or as nothing
            value = one(digest, lambda: f"{some(_HEXES, 8, 8)}-{some(_HEXES, 4, 4)}-{some(_HEXES, 4, 4)}-{some(_HEXES, 4, 4)}-{some(_HEXES, 12, 12)}")()
            before += one("commit ", "sha256:", "sha1 ", "md5: ", "checksum ", "etag: ", "digest=", "revision ", "uuid ", "") if r.random() < 0.9 else ""
            secret = 0
        else:
            value = one(
                lambda: "".join(plain() for _ in range(4)) + one("", "", digits(1, 2), "."),
                lambda: "".join(plain() for _ in range(4)) + one("", "."),
                lambda: "".join(plain() for _ in range(3)).upper() + one("", ".", plain().upper()),
                lambda: "_".join(plain() for _ in range(4)) + one("", "_" + digits(1, 3)),
                lambda: f"{int(r.integers(1990, 2030))}-{int(r.integers(10, 13))}-{int(r.integers(10, 29))}T{digits(6, 6)}.{digits(3, 6)}",
                lambda: "/".join(plain() for _ in range(int(r.integers(3, 8)))) + "/" + plain() + digits(1, 4) + one(".html", ".txt", ".py", "/index"),
                lambda: "/".join(plain() for _ in range(int(r.integers(4, 9)))),
                lambda: f"{plain()}-{digits(1, 2)}.{digits(1, 2)}.{digits(1, 2)}-{plain()}-{plain()}",
                lambda: one("www.", "mail.", "") + plain() + digits(1, 3) + "." + plain() + one(".com", ".org", ".example.net", ".example.com"),
                lambda: "-".join(plain() for _ in range(4)) + one("", "-" + digits(1, 4)),
                lambda: one("=", "-", ".", "_", "/") * int(r.integers(16, 60)),
                lambda: "=" * int(r.integers(8, 30)) + plain() + one("", digits(1, 2)) + "=" * int(r.integers(4, 9)),
                lambda: plain().capitalize() + plain().capitalize() + plain().capitalize() + one("", digits(1, 3)) + plain().capitalize(),
                lambda: one("IMG_", "DSC-", "scan.", "order-", "INV/") + digits(8, 8) + one("_", "-") + digits(4, 8) + one("", ".jpg", ".pdf"),
                lambda: ".".join(plain() for _ in range(4)) + one("", "." + digits(1, 2)),
            )()
            if len(value) < 16:
                value += "-" + "".join(plain() for _ in range(6))
            before += one("", words(2) + " ", "see ", "http://", "id: ", "version = ", '"', "file ", "key = ", digits(1, 2) + "@")
            secret = 0
        out.append((before + value + after, len(before), len(before) + len(value), secret))
    return out


def fit(findings: Iterable[tuple[str, int, int, int]] | DataFrame | None = None, limit: int = FINDINGS, recall: float = RECALL) -> Network:
    """The network fitted on labelled findings: a table of them (its first ``limit`` rows by hash), a list, or the default."""
    if isinstance(findings, DataFrame):
        rows = findings.selectExpr("text", "cast(start as int) start", "cast(`end` as int) `end`", "cast(is_secret as int) is_secret").dropna()
        findings = [tuple(r) for r in rows.orderBy(F.xxhash64("text", "start"), "text", "start").limit(limit).collect()]
    findings = list(labelled_findings() if findings is None else findings)[:limit]
    read = [windows(t, s, e) for t, s, e, _ in findings]
    y = np.array([k for *_, k in findings], np.float64)
    net = Network()
    turn = np.random.default_rng(3).permutation(len(read)) % 20
    train = np.flatnonzero(turn < 14)
    net.train(np.array([x for i in train for x in read[i]]), np.array([y[i] for i in train for _ in read[i]]))
    decides = lambda some: np.array([read[i][int(np.argmax(net.logits(np.array(read[i]))))] for i in some])
    warm, last = np.flatnonzero((turn >= 14) & (turn < 17)), np.flatnonzero(turn >= 17)
    net.fit_temperature(decides(warm), y[warm])
    net.set_threshold(decides(last), y[last], recall)
    return net


# ---------------------------------------------------------------- scans


def best_scores(net: Network, found: list[tuple[str, int, int]]) -> np.ndarray:
    """The score of each candidate: the greatest of its windows."""
    out, rows, owner = np.zeros(len(found)), [], []
    for i, (text, start, end) in enumerate(found):
        for x in windows(text, start, end):
            rows.append(x)
            owner.append(i)
            if len(rows) == 4096:
                np.maximum.at(out, owner, net.scores(np.array(rows)))
                rows, owner = [], []
    if rows:
        np.maximum.at(out, owner, net.scores(np.array(rows)))
    return out


def scan_texts(net: Network, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
    """For each text its spans (start, end, kind, score), by start, then kind."""
    base = [base_spans(t) if t else [] for t in texts]
    more = [candidates(t, b) if t else [] for t, b in zip(texts, base, strict=True)]
    where = [(i, s, e, k) for i, b in enumerate(base) for s, e, k in b] + [(i, s, e, "model") for i, m in enumerate(more) for s, e in m]
    out: list[list] = [[] for _ in texts]
    for at in range(0, len(where), 4096):
        some = where[at : at + 4096]
        for (i, s, e, k), score in zip(some, best_scores(net, [(texts[i], s, e) for i, s, e, _ in some]).tolist(), strict=True):
            if k != "model" or score >= net.threshold:
                out[i].append((s, e, k, score))
    for spans in out:
        spans.sort(key=lambda x: (x[0], KINDS.index(x[2]), x[1]))
    return out


def scan(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, findings: array of (start, end, kind, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [[dict(zip(("start", "end", "kind", "score"), x, strict=True)) for x in spans] for spans in scan_texts(shared.value, part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, kind)], ["doc_id", "findings"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, findings array<struct<start: long, `end`: long, kind: string, score: double>>")


def redact(docs: DataFrame, net: Network, mark: str = "[SECRET]") -> DataFrame:
    """The documents, all columns, with every finding's span replaced by ``mark`` (spans that overlap by one mark); n_chars, if there, follows."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    at = names.index("text")
    count = next((k for k, f in enumerate(docs.schema) if f.name == "n_chars" and f.dataType.simpleString() in ("int", "bigint")), None)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 500):
                b = whole.slice(first, 500)
                texts = b.column(at).to_pylist()
                changed = []
                for i, spans in enumerate(scan_texts(shared.value, texts)):
                    if not spans:
                        continue
                    out, end = [], 0
                    for s, e, *_ in spans:
                        if s >= end:
                            out += [texts[i][end:s], mark]
                        end = max(end, e)
                    texts[i] = "".join([*out, texts[i][end:]])
                    changed.append(i)
                columns = list(b.columns)
                if changed:
                    columns[at] = pa.array(texts, b.schema.field(at).type)
                    if count is not None:
                        sizes = b.column(count).to_pylist()
                        for i in changed:
                            sizes[i] = len(texts[i])
                        columns[count] = pa.array(sizes, b.schema.field(count).type)
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_model."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = scan_texts(shared.value, part.column(1).to_pylist())
                told = [[f"{k}:{s}:{e}" for s, e, k, _ in spans] for spans in found]
                counts = [pa.array([sum(x[2] == k for x in spans) for spans in found], pa.int64()) for k in KINDS]
                base = [hashlib.sha256(",".join(x for x in t if not x.startswith("model")).encode()).hexdigest() for t in told]
                columns = [part.column(0), *counts[:3], pa.array(base, pa.string()), pa.array([",".join(t) for t in told], pa.string()), counts[3]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_model"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_model long")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), fit())
