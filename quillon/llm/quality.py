"""Compression classifier: which of two zstandard dictionaries, of good or of bad text, packs a document smaller.

The dictionaries are raw content taken from labelled texts. A document is cut into chunks, each chunk is
compressed with either dictionary, and the summed sizes give the normalised difference
(bad - good) / (bad + good), in -1..1. This is done on two channels, the bytes themselves and their
shapes (which no language decides). A logistic curve fitted on labelled texts that aren't in the dictionaries, weighted
to the labels' rate, turns the two differences, and the logarithm of the compressed share, into a score.

Defined results: null and empty texts have features of 0, so the score is the curve's value there; texts of any
length are scored whole, chunk by chunk; each row of the input gives a row, repeated ones the same score, also with a
null doc_id (which is never held out); ties between labelled rows for the sample go by hash, then doc_id; doc_ids
with both labels teach nothing; without labels of both kinds the score is 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What training may gather: rows per label, and bytes of a text for it to be eligible. A sample of labelled rows only.
TRAIN_ROWS, TRAIN_BYTES = 1200, 16_384
DICT_BYTES, CHUNK_BYTES, LEVEL = 112_640, 1_024, 9
#: The least score of an accepted text.
ACCEPT = 0.7


#: Shapes: letters of either case, digits and bytes beyond ASCII each become one symbol; marks and spaces stay.
SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))


class Model:
    """For each channel a pair of dictionaries, good and bad, and the logistic curve's weights, the offset last."""

    def __init__(self, pairs: list[tuple[bytes, bytes]], weights: list[float]):
        self.pairs, self.weights = pairs, weights
        self._packers = None

    def __getstate__(self):
        return self.__dict__ | {"_packers": None}

    def features(self, text: str | None) -> list[float]:
        """The normalised difference of compressed sizes in each channel, and the logarithm of the mean compressed share (text that repeats itself packs well with either dictionary)."""
        data = (text or "").encode("utf-8", "replace")
        if not data or not self.pairs:
            return [0.0] * (len(self.pairs) + 1)
        if self._packers is None:
            self._packers = [[_packer(content) for content in pair] for pair in self.pairs]
        out, sizes = [], 0
        for channel, pair in zip((data, data.translate(SHAPE)), self._packers, strict=True):
            good, bad = (sum(len(p.compress(channel[i : i + CHUNK_BYTES])) for i in range(0, len(channel), CHUNK_BYTES)) for p in pair)
            out.append((bad - good) / (bad + good))
            sizes += good + bad
        return [*out, math.log(sizes / (4 * len(data)))]

    def score(self, text: str | None) -> float:
        x = sum(w * f for w, f in zip(self.weights, [*self.features(text), 1.0], strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, x))))


def _packer(content: bytes) -> zstandard.ZstdCompressor:
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)


def _content(texts: list[bytes]) -> bytes:
    """Dictionary content: an equal share of each text, from its middle, until the dictionary is full."""
    share = max(64, DICT_BYTES // max(1, len(texts)))
    parts = [data[(at := max(0, (len(data) - share) // 2)) : at + share] for data in texts]
    return b"\n".join(parts)[:DICT_BYTES]


def _logistic(x: np.ndarray, y: np.ndarray, rate: float, steps: int = 50) -> list[float]:
    """Newton's method with a slight penalty on the slopes; rows weigh so that label 1 has the share `rate`. The offset comes last."""
    weight = np.where(y == 1, rate / max(1, (y == 1).sum()), (1 - rate) / max(1, (y == 0).sum())) * len(y)
    scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1.0)
    z = np.column_stack([x / scale, np.ones(len(x))])
    penalty = np.array([1e-1] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (weight * (p - y)) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return [*(w[:-1] / scale).tolist(), float(w[-1])]


def fit(good: list[str], bad: list[str], rate: float = 0.5) -> Model:
    """good, bad: texts; half of each makes the dictionaries, the other half fits the curve. rate: the share of good ones among all, to which the score is calibrated."""
    if len(good) < 2 or len(bad) < 2:
        return Model([], [0.0, 0.0])
    halves = [[t.encode() for t in texts[::2]] for texts in (good, bad)]
    pairs = [tuple(_content([t.translate(SHAPE) if shaped else t for t in texts]) for texts in halves) for shaped in (False, True)]
    model = Model(pairs, [])
    x = np.array([model.features(t) for t in [*good[1::2], *bad[1::2]]])
    y = np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2]))
    model.weights = _logistic(x, y, rate)
    return model


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> Model:
    """Fits on at most `rows` labelled texts of each label (of at most `most_bytes`), lowest hash of doc_id first; never on rows whose crc32(doc_id) mod 4 is 2."""
    marked = labels.where(F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"), F.max("quality").alias("_other")).where("quality = _other and crc32(cast(doc_id as string)) % 4 != 2").drop("_other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.octet_length("text").between(1, most_bytes))
    counts = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = []
    for label in (1, 0):
        lot = marked.where(F.col("quality") == label).select("doc_id", F.xxhash64("doc_id").alias("_h")).orderBy("_h", "doc_id").limit(rows)
        picked.append([r["text"] for r in texts.join(F.broadcast(lot), "doc_id").orderBy("_h", "doc_id", "text").limit(rows).collect()])
    return fit(*picked, rate=(counts.get(1, 0) + 1) / (sum(counts.values()) + 2))


def _scored(docs: DataFrame, model: Model) -> Column:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # four dictionaries of 110 KB at most

    @F.pandas_udf("double")
    def score(text):
        return text.map(shared.value.score, na_action=None).astype(float)

    return score(F.col("text"))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """docs with two more columns, `score` and `predicted` (1 from 0.7 on). Same-named columns of docs are replaced."""
    return docs.withColumn("score", _scored(docs, model)).withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the classifier accepts; all of them if there was nothing to learn from."""
    if not model.pairs:
        return docs
    return docs.where(_scored(docs, model) >= ACCEPT)


def op_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    return scores(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels)).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")
