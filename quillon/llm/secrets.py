"""Secret scans: fixed patterns, and a battery of randomness tests with length-aware false-discovery control.

Any further run of key characters is a candidate, and so are its parts of 16 characters or more between `/`, `+`,
`-` and `_`, as a path or a name may stand before a key. A part within an accepted run isn't named again. The
narrowest alphabet that holds a candidate gives its encoding; runs of separators alone have none. Three tests ask
whether its symbols look drawn evenly and independently from that alphabet: chi-squared uniformity,
runs about the median symbol, lag-one serial correlation. A key must pass all three together. Ordinary
text of few letters passes them too, so the chi-squared statistic is also held against its distribution
for text with the byte frequencies of the whole corpus. That p-value falls with length, and the
Benjamini-Hochberg rule is applied to it within each band of lengths over all candidates of the corpus.

Defined results: a null text counts as empty; a row without spans has empty `spans` and the hash of the
empty string; repeated rows each give a row, also with a null doc_id; texts of any length are scanned whole, in a
task each; spans that start together stand in the order of their kinds; an empty table gives an empty result; other
columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import dropped, whole_row, written

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so shorter runs are dropped as they fail
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
PART = re.compile(r"[A-Za-z0-9]{16,}")

#: Encodings from the narrowest alphabet to the widest, each in symbol order.
_UP, _LOW, _DIG = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ENCODINGS = (("base10", _DIG), ("hex", _DIG + "abcdef"), ("hex_upper", _DIG + "ABCDEF"), ("base26", _LOW), ("base26_upper", _UP), ("base32", _UP + "234567"), ("base36", _DIG + _LOW), ("base36_upper", _DIG + _UP), ("base52", _UP + _LOW), ("base62", _DIG + _UP + _LOW), ("base64", _UP + _LOW + _DIG + "+/"), ("base64url", _UP + _LOW + _DIG + "_-"))
_SETS = [frozenset(a) for _, a in ENCODINGS]
_INDEX = [{c: i for i, c in enumerate(a)} for _, a in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns, leftmost and not overlapping within a kind, by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def encoding_of(token: str) -> int | None:
    """Index of the narrowest encoding, or None for tokens that fit none or hold no letter or digit."""
    seen = set(token)
    if not seen - set("+/_-"):
        return None
    return next((i for i, s in enumerate(_SETS) if seen <= s), None)


def battery(token: str, enc: int) -> tuple[float, float]:
    """The chi-squared statistic of even use of the alphabet, and Fisher's combined p-value of the three tests of randomness."""
    at = np.fromiter(map(_INDEX[enc].__getitem__, token), dtype=np.float64, count=len(token))
    k, n = len(_SETS[enc]), len(token)
    counts = np.bincount(at.astype(np.int64), minlength=k)
    x2 = float(((counts - n / k) ** 2).sum() * k / n)
    p_even = _two_sided(max(0.0, (x2 - (k - 1)) / math.sqrt(2 * (k - 1)))) if x2 > k - 1 else 1.0
    above = at >= k / 2
    m, rest = int(above.sum()), n - int(above.sum())
    if m and rest:
        mean = 2 * m * rest / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = _two_sided((1 + int((above[1:] != above[:-1]).sum()) - mean) / math.sqrt(var)) if var > 0 else 1.0
    else:
        p_runs = 2.0 ** (1 - n)
    centred = at - at.mean()
    spread = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    p_serial = _two_sided((r + 1 / n) * math.sqrt(n))
    s = -sum(math.log(max(p, 1e-300)) for p in (p_even, p_runs, p_serial))  # half of Fisher's statistic, six degrees
    return x2, min(1.0, math.exp(-s) * (1 + s + s * s / 2))


def _of_text(text: str) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """The fixed patterns' spans; and for each run of key characters the candidates outside those spans with their statistics: the run itself, or None, and its parts."""
    base, runs = base_spans(text), []
    begins, ends = _joined(base)

    def candidate(start: int, end: int) -> dict | None:
        enc, i = encoding_of(text[start:end]), bisect.bisect_right(ends, start)
        if enc is None or (i < len(begins) and begins[i] < end):  # of the spans that end behind `start` the first begins before `end`
            return None
        x2, p_random = battery(text[start:end], enc)
        return {"start": start, "end": end, "n": end - start, "enc": enc, "x2": x2, "p_random": p_random}

    for m in CANDIDATE.finditer(text):
        run, parts = candidate(*m.span()), [candidate(*x.span()) for x in PART.finditer(text, *m.span()) if x.span() != m.span()]
        parts = [x for x in parts if x]
        if run or parts:
            runs.append({"run": run, "parts": parts})
    return base, runs


def _joined(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Begins and ends of the union of sorted spans."""
    begins, ends = [], []
    for _, a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    return begins, ends


#: Rows whose candidates a task holds as Python objects at once.
SCAN_ROWS = 500


def _scan(batches):
    for batch in batches:
        for part in (batch.slice(at, SCAN_ROWS) for at in range(0, batch.num_rows, SCAN_ROWS)):
            ids, texts, rows = part.column(0).to_pylist(), part.column(1), []
            for i in range(len(ids)):
                base, runs = _of_text(texts[i].as_py() or "")
                rows.append({"doc_id": ids[i], "base": [{"kind": k, "start": a, "end": b} for k, a, b in base], "runs": runs, "bytes": None})
            joined = texts.cast(pa.large_binary())
            offsets = np.frombuffer(joined.buffers()[1], dtype=np.int64)[joined.offset : joined.offset + len(joined) + 1]
            data = np.frombuffer(joined.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if joined.buffers()[2] else np.zeros(0, np.uint8)
            rows.append({"doc_id": None, "base": [], "runs": [], "bytes": np.bincount(data, minlength=256).tolist()})
            yield pa.RecordBatch.from_pylist(rows, schema=_SCANNED)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_CAND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("n", pa.int32()), ("enc", pa.int32()), ("x2", pa.float64()), ("p_random", pa.float64())])
_SCANNED = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(_SPAN)), ("runs", pa.list_(pa.struct([("run", _CAND), ("parts", pa.list_(_CAND))]))), ("bytes", pa.list_(pa.int64()))])
_CAND_SQL = "struct<start:long,end:long,n:int,enc:int,x2:double,p_random:double>"


def text_moments(byte_counts: np.ndarray) -> list[tuple[float, float, float, float]]:
    """For each encoding a, b, c, d: in text the statistic of n symbols has mean a*n + b and variance c*n + d."""
    out = []
    for _, alphabet in ENCODINGS:
        k = len(alphabet)
        q = byte_counts[[ord(c) for c in alphabet]].astype(float) + 1
        q /= q.sum()
        s2, s3 = float((q**2).sum()), float((q**3).sum())
        out.append((k * s2 - 1, k * (1 - s2), 4 * k * k * (s3 - s2 * s2), 2 * k * k * (s2 - 2 * s3 + s2 * s2)))
    return out


def bh_limits(bins: pd.DataFrame, alpha: float) -> dict[int, float]:
    """Of counts by (band, z bin of 1/16 from below), the largest z of each band that the Benjamini-Hochberg rule accepts."""
    out = {}
    for band, part in bins.groupby("band"):
        part = part.sort_values("bin")
        z = (part["bin"].to_numpy() + 1) / 16  # a bin's upper edge, so that the rule errs to the safe side
        p = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
        ok = np.flatnonzero(p <= alpha * part["n"].cumsum().to_numpy() / part["n"].sum())
        if len(ok):
            out[int(band)] = float(z[ok[-1]])
    return out


class Rule:
    """What the whole corpus decides about spans of kind random: the moments of the statistic in text, and the largest z accepted in each band of lengths."""

    def __init__(self, moments: list[tuple[float, float, float, float]], limits: dict[int, float], least_random: float):
        self.moments, self.limits, self.least_random = moments, limits, least_random

    def spans(self, text: str | None) -> list[tuple[str, int, int]]:
        """All spans of a text, by start and then kind."""
        base, runs = _of_text(text or "")
        more = []
        for r in runs:
            for c in [r["run"]] if r["run"] and self.accepts(r["run"]) else filter(self.accepts, r["parts"]):
                more.append(("random", c["start"], c["end"]))
        return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))

    def accepts(self, c: dict) -> bool:
        a, b, v, w = self.moments[c["enc"]]
        z = (c["x2"] - (a * c["n"] + b)) / math.sqrt(v * c["n"] + w)
        return c["p_random"] >= self.least_random and math.floor(z * 16) / 16 < self.limits.get(int(math.log2(c["n"])), -math.inf)

    def redact(self, text: str | None, mark: str = "[SECRET]") -> str | None:
        """The text with `mark` in place of its spans; overlapping spans get one."""
        if text is None:
            return None
        out, at = [], 0
        for _, start, end in self.spans(text):
            if start >= at:
                out += [text[at:start], mark]
            at = max(at, end)
        return "".join([*out, text[at:]]) if at else text


def _scanned(docs: DataFrame, alpha: float, least_random: float) -> tuple[DataFrame, Rule]:
    """The written scan, a row per row of docs and one with byte counts per batch; and the rule. The driver gets the corpus's byte counts (256 numbers) and counts of candidates by band and z bin, of fixed size."""
    scanned = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan, f"doc_id long, base array<struct<kind:string,start:long,end:long>>, runs array<struct<run:{_CAND_SQL},parts:array<{_CAND_SQL}>>>, bytes array<long>"), "secrets")
    totals = scanned.filter("bytes is not null").agg(*[F.sum(F.col("bytes")[i]).alias(f"b{i}") for i in range(256)]).first()
    moments = text_moments(np.array([x or 0 for x in totals]))
    both = F.flatten(F.transform("runs", lambda r: F.concat(F.array_compact(F.array(r["run"])), r["parts"])))
    each = scanned.filter("bytes is null").select(F.explode(both).alias("x")).where(F.col("x.p_random") >= least_random)
    bins = each.select(_band(F.col("x")).alias("band"), F.greatest(F.lit(-640), F.floor(_z(F.col("x"), moments) * 16)).cast("int").alias("bin")).groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n")).toPandas()
    return scanned, Rule(moments, bh_limits(bins, alpha), least_random)


def _band(x: Column) -> Column:
    return F.floor(F.log2(x["n"].cast("double"))).cast("int")


def _z(x: Column, moments: list[tuple[float, float, float, float]]) -> Column:
    a, b, v, w = (F.element_at(F.array(*[F.lit(float(m[i])) for m in moments]), x["enc"] + 1) for i in range(4))
    return (x["x2"] - (a * x["n"] + b)) / F.sqrt(v * x["n"] + w)


def find_secrets(docs: DataFrame, alpha: float = 0.01, least_random: float = 0.001) -> DataFrame:
    """One row per row of docs: doc_id and `spans`, an array of (kind, start, end) in code points, by start and then kind.

    alpha: the share of false discoveries allowed among the spans of kind random, in each band of lengths
    (a band doubles the length). least_random: the least p-value of the randomness battery.
    """
    scanned, rule = _scanned(docs, alpha, least_random)
    no = F.lit(float("-inf"))
    limit = lambda x: F.coalesce(F.element_at(F.create_map(*[F.lit(y) for kv in rule.limits.items() for y in kv]), _band(x)), no) if rule.limits else no
    passes = lambda x: (x["p_random"] >= least_random) & (F.floor(_z(x, rule.moments) * 16) / 16 < limit(x))
    of_run = lambda r: F.when(F.coalesce(passes(r["run"]), F.lit(False)), F.array(r["run"])).otherwise(F.filter(r["parts"], passes))  # noqa: E731  parts within an accepted run aren't named again
    order = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    place = lambda kind, x: F.struct(x["start"].alias("start"), order(kind).alias("order"), kind.alias("kind"), x["end"].alias("end"))
    found = F.concat(F.transform("base", lambda x: place(x["kind"], x)), F.transform(F.flatten(F.transform("runs", of_run)), lambda x: place(F.lit("random"), x)))
    spans = F.transform(F.array_sort(found), lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    return scanned.filter("bytes is null").select("doc_id", spans.alias("spans"))


def redacted(docs: DataFrame, alpha: float = 0.01, least_random: float = 0.001) -> DataFrame:
    """docs with a mark in place of every span in `text`; `n_chars`, where there is one, follows a text that changed. One pass finds the rule, another applies it; rows aren't joined, so any rows will do."""
    scanned, rule = _scanned(docs, alpha, least_random)
    dropped(scanned)

    @F.pandas_udf("string")
    def clean(text):
        return text.map(rule.redact, na_action="ignore")

    row = docs.select(whole_row(docs).alias("row"), clean("text").alias("clean"))
    changed = ~F.col("row.text").eqNullSafe(F.col("clean"))
    kind = dict(docs.dtypes)
    new = {"text": F.col("clean"), "n_chars": F.when(changed, F.length("clean")).otherwise(F.col("row.n_chars")).cast(kind["n_chars"]) if "n_chars" in kind else None}
    return row.select(*[(new[c] if c in new else F.col("row")[c]).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The counts, the hash of the fixed patterns' spans, and all spans as a string."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in KINDS], F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "random")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
