"""Secret scanning: fixed patterns and a battery of randomness tests.

Every run of at least `SHORTEST` key characters outside the patterns' spans is tested in the encoding that its characters suggest (hex,
base32 or base64): chi-squared uniformity over the alphabet, the number of runs about the alphabet's middle, and the correlation of
neighbouring symbols. A run passes where the Bonferroni-combined p-value keeps uniform randomness plausible. Whether a run that passes is more
than chance is judged against a fixed model of ordinary runs (words, numbers and separators that follow each other, by character kinds and
letter frequencies): the likelihood of the run under uniform draws over that under the model exceeds t in at most one of t ordinary runs,
so its inverse is a p-value, which falls with the run's length by itself. Benjamini and Hochberg's procedure over all tested runs of the table
sets the bound that keeps the expected share of false discoveries within `FDR`. No ordinary runs need to be in the table.

Null and empty texts have no spans; repeated rows are answered alike; a null doc_id keeps its row; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, code_points, slices

# The patterns of the base kinds, in the order in which they are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

SHORTEST, ALPHA, FDR = 20, 0.01, 0.01
HEX, BASE32 = set("0123456789abcdef"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

SEPARATORS = "+/_=-"
# The fixed model of ordinary runs: kinds of neighbouring characters (lower, upper, digit, separator; rows sum to 1) and frequencies of letters in parts of 1000
FOLLOWS = np.log([[0.90, 0.02, 0.02, 0.06], [0.50, 0.40, 0.04, 0.06], [0.04, 0.04, 0.80, 0.12], [0.55, 0.20, 0.20, 0.05]])
LETTERS = dict(zip("abcdefghijklmnopqrstuvwxyz", (80, 17, 32, 40, 118, 19, 20, 40, 72, 5, 10, 40, 26, 70, 72, 22, 3, 62, 64, 84, 32, 12, 17, 4, 17, 7)))
STEPS, MOST_LEVEL = 4, 400  # p-values are e^(-level / STEPS), rounded up; lower ones than the last level's count as that

DRAFT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<start:int,kind:string,end:int>>, runs array<struct<start:int,end:int,level:int>>"
_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
    ("base", pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))),
    ("runs", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("level", pa.int32())]))),
])


def _class(chars: str) -> np.ndarray:
    out = np.zeros(129, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_HEX = _class("0123456789abcdef")
_KEY = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-")


def _runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= least
    return start[long], end[long]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of assign and access; hex is found over whole batches."""
    out = []
    low = text.lower()
    if any(k in low for k in ("passw", "secret", "token", "api")):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    return out


def _tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def randomness(token: str) -> float:
    """Combined p-value of the battery under uniform randomness in the inferred encoding; 0 for digits alone."""
    s = token.rstrip("=").replace("-", "+").replace("_", "/")
    chars = set(s)
    if len(s) < 8 or chars <= set("0123456789"):
        return 0.0
    if chars <= HEX or (s.upper() == s and chars <= set("0123456789ABCDEF")):
        s, alphabet = s.lower(), ALPHABETS["hex"]
    elif chars <= BASE32:
        alphabet = ALPHABETS["base32"]
    else:
        alphabet = ALPHABETS["base64"]
    x = np.array([alphabet.find(c) for c in s])
    if (x < 0).any():
        return 0.0
    n, a = len(x), len(alphabet)
    counts = np.bincount(x, minlength=a)
    chi = float(((counts - n / a) ** 2).sum() * a / n)
    p = [0.5 * math.erfc((math.sqrt(2 * chi) - math.sqrt(2 * (a - 1) - 1)) / math.sqrt(2))]
    up = x >= a / 2
    n1 = int(up.sum())
    n0 = n - n1
    if not n1 or not n0:
        p.append(2.0 ** (1 - n))
    else:
        mean = 2 * n0 * n1 / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(_tail((1 + int((up[1:] != up[:-1]).sum()) - mean) / math.sqrt(max(var, 1e-9))))
        p.append(_tail((n1 - n / 2) / math.sqrt(n / 4)))
    d = x - (a - 1) / 2
    p.append(_tail(float((d[1:] * d[:-1]).sum() / (d * d).sum()) * math.sqrt(n)))
    return min(1.0, len(p) * min(p))


def _ordinary_model() -> tuple[np.ndarray, np.ndarray]:
    """Kind and log-probability within the kind of each ASCII character."""
    kind, log_p = np.full(128, 3), np.full(128, -math.log(len(SEPARATORS)))
    for c, n in LETTERS.items():
        for k, x in enumerate((c, c.upper())):
            kind[ord(x)], log_p[ord(x)] = k, math.log(n / sum(LETTERS.values()))
    kind[48:58], log_p[48:58] = 2, -math.log(10)
    return kind, log_p


_KIND, _LOG_P = _ordinary_model()
_ENCODINGS = [np.isin(np.arange(128), [ord(c) for c in a]) for a in (ALPHABETS["hex"], ALPHABETS["hex"].upper(), ALPHABETS["base32"], ALPHABETS["base64"], ALPHABETS["base64"][:62] + "-_")]


def advantage(token: str) -> float:
    """Log-likelihood of uniform draws from the encodings (each alike likely) less that of an ordinary run."""
    x = np.frombuffer(token.rstrip("=").encode("ascii"), dtype=np.uint8)
    if not len(x):
        return 0.0
    uniform = [-len(x) * math.log(e.sum()) for e in _ENCODINGS if e[x].all()]
    if not uniform:
        return 0.0
    k = _KIND[x]
    ordinary = -math.log(4) + float(FOLLOWS[k[:-1], k[1:]].sum()) + float(_LOG_P[x].sum())
    most = max(uniform)
    return most + math.log(sum(math.exp(u - most) for u in uniform) / len(_ENCODINGS)) - ordinary


def level(token: str) -> int:
    """The run's p-value under the model of ordinary runs, as a level; 0 (a p-value of 1) where the battery excludes uniform randomness."""
    if randomness(token) < ALPHA:
        return 0
    return min(MOST_LEVEL, max(0, math.floor(STEPS * advantage(token))))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` with its base spans and every tested run (schema DRAFT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=4_000_000):
            ids, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
            points, starts = code_points(texts)
            points = np.minimum(points, 128)
            hexes: dict[int, list] = {}
            for s, e in zip(*_runs(_HEX[points], LEAST_HEX)):
                hexes.setdefault(int(np.searchsorted(starts, s, side="right") - 1), []).append((int(s), int(e)))
            keys: dict[int, list] = {}
            for s, e in zip(*_runs(_KEY[points], SHORTEST)):
                keys.setdefault(int(np.searchsorted(starts, s, side="right") - 1), []).append((int(s), int(e)))
            out: dict = {k: [] for k in _SCHEMA.names}
            for i, (doc, text) in enumerate(zip(ids, texts)):
                at = int(starts[i])
                base = base_spans(text) + [(2, s - at, e - at) for s, e in hexes.get(i, ())]
                base.sort(key=lambda x: (x[1], x[0]))
                joined = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in base)
                runs = []
                for s, e in keys.get(i, ()):
                    s, e = s - at, e - at
                    if not any(x < e and s < y for _, x, y in base):
                        token = text[s:e]
                        runs.append({"start": s, "end": e, "level": level(token)})
                kinds = [k for k, _, _ in base]
                row = (doc, *(kinds.count(k) for k in range(3)), hashlib.sha256(joined.encode()).hexdigest(), [{"start": s, "kind": KINDS[k], "end": e} for k, s, e in base], runs)
                for k, v in zip(_SCHEMA.names, row):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=_SCHEMA)

    return docs.select("doc_id", "text").mapInArrow(run, DRAFT)


def trusted_level(scanned: DataFrame, fdr: float = FDR) -> int:
    """The least level that Benjamini and Hochberg's procedure reports; MOST_LEVEL + 1 where it reports none. At most MOST_LEVEL + 1 rows reach the driver."""
    count = {r.level: r["count"] for r in scanned.select(F.explode("runs").alias("r")).select("r.level").groupBy("level").count().collect()}
    tested, found, out = sum(count.values()), 0, MOST_LEVEL + 1
    for at in sorted(count, reverse=True):
        found += count[at]
        if math.exp(-at / STEPS) * tested <= fdr * found:
            out = at
    return out


def secrets(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for each row of `docs`; the battery's spans are of kind `random`."""
    scanned = Scratch(docs.sparkSession).keep(scan(docs), "scanned")
    least = trusted_level(scanned, fdr)
    added = F.transform(
        F.filter("runs", lambda r: r["level"] >= least),
        lambda r: F.struct(r["start"].alias("start"), F.lit("random").alias("kind"), r["end"].alias("end")),
    )
    order = lambda k: F.array_position(F.array(*[F.lit(x) for x in (*KINDS, "random")]), k)
    spans = F.array_sort(F.transform(F.concat("base", added), lambda r: F.struct(r["start"].alias("start"), order(r["kind"]).alias("order"), r["kind"].alias("kind"), r["end"].alias("end"))))
    text = F.array_join(F.transform(spans, lambda r: F.concat_ws(":", r["kind"], r["start"], r["end"])), ",")
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", text.alias("spans"))
