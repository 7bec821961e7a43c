"""Token ids packed into rows of a fixed length by best-fit decreasing, with a segment tree over capacities.

1. Texts are encoded with a public tokenizer, an end id is added, and longer ones are cut into pieces of at
   most a row. Pieces keep their document and number, so joining them gives the ids back without loss.
2. Only lengths decide a packing. The histogram of piece lengths (at most one entry a length) goes to the
   driver, where best-fit decreasing runs over whole runs of equal pieces: bins are kept as intervals by free
   capacity, and a segment tree finds the least capacity that is large enough. The result is a list of moves,
   each for a run of equal pieces, whose number depends on the row length and not on the corpus.
3. Each piece is ranked among those of its length and finds its move, bin and offset. Bins are dealt to tasks
   and written as rows of ids.

Defined results: a null or empty text is the end id alone; repeated rows are packed each, as are texts that share
a doc_id or have none; a text longer than a row is cut into pieces, each whole in one row, and encoded in one task;
ties go by task and place; an empty table gives no rows; other columns are ignored. Ids are little-endian, two bytes each up to 65,536 ids, else four.
"""

from __future__ import annotations

import base64
import functools
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
ROW, END, PAD = 2048, 50_256, 50_256
#: Rows of the table of rank offsets (tasks x lengths) up to which it is broadcast, 24 bytes each; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 250_000

# Fixed value: the public pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@functools.cache
def encoding_of(content: bytes) -> tiktoken.Encoding:
    """The encoding of a vocabulary file's content; a worker builds it once."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        return encoding_of(file.read())


#: White space as the pattern knows it, in runs so long that the pattern's engine, which looks back from the end of a run, might run out of stack.
LONG_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def ids_of(enc: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of a text, of any length. The pattern takes a run of white space as one piece, but for its last character where something follows; long runs are cut out so beforehand."""
    out, at = [], 0
    for run in LONG_SPACE.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += enc.encode_ordinary(text[at : run.start()])
        out += enc._encode_single_piece(text[run.start() : end])
        at = end
    return out + enc.encode_ordinary(text[at:])


def _encode(vocabulary, row: int, end: int, kind: str):
    """vocabulary: a broadcast of the file's content, as executors need not have the file."""

    def scan(batches):
        from pyspark import TaskContext

        part, enc, seen = TaskContext.get().partitionId(), encoding_of(vocabulary.value), defaultdict(int)
        for batch in batches:
            columns = [[] for _ in range(7)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*ids_of(enc, text.as_py() or ""), end], dtype=kind)
                for piece, at in enumerate(range(0, len(ids), row)):
                    n = min(row, len(ids) - at)
                    for column, value in zip(columns, (doc, piece, at, n, part, seen[n], ids[at : at + n].tobytes())):
                        column.append(value)
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["doc_id", "piece", "start", "n", "part", "seq", "ids"])

    return scan


class Capacities:
    """A segment tree over free capacities 0..row that knows which ones some bin has."""

    def __init__(self, row: int):
        self.size = 1 << row.bit_length()
        self.some = [False] * (2 * self.size)

    def set(self, capacity: int, some: bool) -> None:
        i = self.size + capacity
        self.some[i] = some
        while i > 1:
            i //= 2
            self.some[i] = self.some[2 * i] or self.some[2 * i + 1]

    def least(self, at_least: int) -> int | None:
        """The least capacity of `at_least` or more that some bin has."""
        i = self.size + at_least
        while not self.some[i]:
            while i & 1:  # up, until there is a right neighbour
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:
                return None
        while i < self.size:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        return i - self.size


def plan(histogram: dict[int, int], row: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing for all pieces at once: moves (length, first rank, ranks, first bin, pieces a bin, offset) and the number of bins.

    The pieces of a move fill one bin after the other. Among bins of equal capacity any may be taken.
    """
    tree, free, moves, bins = Capacities(row), defaultdict(list), [], 0
    for n in sorted(histogram, reverse=True):
        rank, left = 0, histogram[n]
        while left:
            capacity = tree.least(n)
            if capacity is None:
                capacity, each = row, row // n
                begin, count = bins, -(-left // each)
                bins += count
            else:
                each = capacity // n
                begin, held = free[capacity].pop()
                count = min(held, -(-left // each))
                if count < held:
                    free[capacity].append((begin + count, held - count))
                tree.set(capacity, bool(free[capacity]))
            took = min(left, count * each)
            moves.append((n, rank, took, begin, each, row - capacity))
            full, rest = divmod(took, each)
            for first, number, remains in ((begin, full, capacity - each * n), (begin + full, 1 if rest else 0, capacity - rest * n)):
                if number and remains:
                    free[remains].append((first, number))
                    tree.set(remains, True)
            rank, left = rank + took, left - took
    return moves, bins


def _assemble(row: int, pad: int, kind: str):
    """From pieces sorted by bin and offset: a row per bin."""

    def rows(part: pa.RecordBatch) -> pa.RecordBatch:
        bins, offset, n = (np.asarray(part.column(c), dtype=np.int64) for c in (0, 1, 2))
        begin = np.flatnonzero(np.diff(bins, prepend=-1))
        ends = np.append(begin[1:], len(bins))
        matrix = np.full((len(begin), row), pad, dtype=kind)
        ids = part.column(5).cast(pa.large_binary())
        flat = np.frombuffer(b"".join(ids.to_pylist()), dtype=kind)
        at = np.repeat(np.repeat(np.arange(len(begin)) * row, ends - begin) + offset - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(flat))
        matrix.ravel()[at] = flat
        cut = pa.array(np.append(begin, len(bins)), pa.int32())
        lists = [pa.ListArray.from_arrays(cut, c) for c in (part.column(3), part.column(4), pa.array(offset.astype(np.int32)))]
        total = np.add.reduceat(n, begin)
        sums = [[*offset[a:b].tolist(), int(t)] for a, b, t in zip(begin, ends, total)]
        return pa.RecordBatch.from_arrays([pa.array(bins[begin]), pa.array(total), lists[0], lists[1], pa.array(sums, pa.list_(pa.int32())), lists[2], pa.array([m.tobytes() for m in matrix], pa.binary())], names=["bin", "n_tokens", "doc_ids", "pieces", "cu_lengths", "resets", "ids"])

    def scan(batches):
        held = None
        for batch in batches:
            if not len(batch):
                continue
            held = pa.Table.from_batches([*([held] if held is not None else []), batch]).combine_chunks().to_batches()[0]
            bins = np.asarray(held.column(0))
            last = int(np.searchsorted(bins, bins[-1]))  # the last bin may go on in the next batch
            done, held = held.slice(0, last), held.slice(last)
            yield from _by_bins(done)
        if held is not None and len(held):
            yield from _by_bins(held)

    def _by_bins(part):
        bins = np.asarray(part.column(0))
        a = 0
        while a < len(bins):
            stop = min(len(bins), a + 4096)
            b = len(bins) if stop == len(bins) else int(np.searchsorted(bins, bins[stop]))
            if b <= a:
                b = int(np.searchsorted(bins, bins[a], side="right"))
            yield rows(part.slice(a, b - a))
            a = b

    return scan


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, row: int = ROW, end: int = END, pad: int = PAD) -> DataFrame:
    """One row per packed row: bin, n_tokens, doc_ids and pieces of its segments, cu_lengths (cumulative segment lengths from 0), resets (where positions start again at 0), ids (row ids, padded)."""
    kind = "<u2" if max(end, pad, encoding(vocabulary).n_vocab) < 65_536 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with open(vocabulary, "rb") as file:
        content = docs.sparkSession.sparkContext.broadcast(file.read())  # a file of fixed size, read by the driver alone
    pieces = written(texts.mapInArrow(_encode(content, row, end, kind), "doc_id long, piece int, start long, n int, part int, seq long, ids binary"), "pieces")
    counts = written(pieces.groupBy("part", "n").agg(F.count(F.lit(1)).alias("c")), "counts")
    moves, _ = plan({r["n"]: r["c"] for r in counts.groupBy("n").agg(F.sum("c").alias("c")).collect()}, row)
    before = Window.partitionBy("n").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "n", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    if counts.count() <= BROADCAST_ROWS:
        offsets = F.broadcast(offsets)
    ranks = pieces.join(offsets, ["part", "n"]).withColumn("rank", F.col("seq") + F.col("before"))
    table = np.array(sorted(moves), dtype=np.int64).reshape(-1, 6)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("bin long, offset int")
    def placed(n: pd.Series, rank: pd.Series) -> pd.DataFrame:
        moves = shared.value
        span = 1 << 44
        i = np.searchsorted(moves[:, 0] * span + moves[:, 1], n.to_numpy() * np.int64(span) + rank.to_numpy(), side="right") - 1
        inside = rank.to_numpy() - moves[i, 1]
        return pd.DataFrame({"bin": moves[i, 3] + inside // moves[i, 4], "offset": (moves[i, 5] + inside % moves[i, 4] * n.to_numpy()).astype(np.int32)})

    put = ranks.withColumn("at", placed("n", "rank")).select("at.bin", "at.offset", "n", "doc_id", "piece", "ids")
    return put.repartition("bin").sortWithinPartitions("bin", "offset").mapInArrow(_assemble(row, pad, kind), "bin long, n_tokens long, doc_ids array<long>, pieces array<int>, cu_lengths array<int>, resets array<int>, ids binary")
