"""Engine B as a run: exact references first, then each payment uses up its best row of equal amount, unless that is a tie.

Payments go newest first, then by id. A payment scores every row that is still free (points for the day, an equal e-mail,
and a bonus where one row alone lies within a week); the best row leaves the pool even when it is only of medium or low
confidence, so what a payment finds depends on all payments before it. A block is a workspace and a signed amount and is allocated in one
task: the order within it is the result itself. Its rows are held by day and by e-mail, so a payment looks at fifteen days and its
own e-mail's rows, not at the block.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import scores as S
from quillon.operators.matching import by_reference

BLOCK = ["workspace_id", "amount"]
WINDOW = 7

_OUT = "workspace_id string, processor_payment_id string, accounting_id string, score int, level string, has_tie boolean, n_candidates long"


def _points(days: int) -> int:
    """S.date_points for one difference of days."""
    return 25 if 0 <= days <= 3 else 12 if 4 <= days <= 7 else 10 if days == -1 else 5 if -7 <= days <= -2 else 0


class Pool:
    """The free rows of a block, by day, e-mail and both."""

    def __init__(self, rows: pd.DataFrame):
        self.row = {}
        self.heaps, self.count = defaultdict(list), Counter()
        for id_, day, email in zip(rows["accounting_id"], rows["acct_day"], rows["email"]):
            day, email = None if pd.isna(day) else int(day), None if pd.isna(email) else email
            self.row[id_] = day, email
            for key in self._keys(day, email):
                self.heaps[key].append(id_)
                self.count[key] += 1
        for heap in self.heaps.values():
            heapq.heapify(heap)

    @staticmethod
    def _keys(day: int | None, email: str | None) -> list[tuple]:
        return [(), ("day", day), *([("email", email), ("both", day, email)] if email is not None else [])]

    def first(self, *key) -> str:
        """The smallest id of the free rows of a key that has some."""
        heap = self.heaps[key]
        while heap[0] not in self.row:
            heapq.heappop(heap)
        return heap[0]

    def take(self, id_: str) -> None:
        for key in self._keys(*self.row.pop(id_)):
            self.count[key] -= 1

    def best(self, day: int | None, email: str | None) -> tuple[str, int, bool, bool] | None:
        """Of all free rows the best for a payment: id, score, whether its e-mail is the payment's, and whether others score alike."""
        n = self.count[()]
        if not n:
            return None
        near = [] if day is None else [d for d in range(day - WINDOW, day + WINDOW + 1) if self.count["day", d]]
        in_window = n if day is None else sum(self.count["day", d] for d in near) + self.count["day", None]
        bonus = 10 + (10 if in_window == 1 else 0)
        found: list[tuple[int, int, str, bool]] = []
        mine = self.count["email", email] if email is not None else 0
        for d in near:
            both = self.count["both", d, email] if mine else 0
            key = ("both", d, email) if both else ("day", d)  # rows of the day without the e-mail score less than those with it
            found.append((40 + _points(d - day) + (bonus if both else 0), both or self.count["day", d], self.first(*key), bool(both)))
            mine -= both
        if mine:  # those far off
            inside = set(near)
            far = min(i for i in self.heaps["email", email] if i in self.row and (self.row[i][0] is None or self.row[i][0] not in inside))
            found.append((40 + bonus, mine, far, True))
        if not found:
            found.append((40, n, self.first(), False))
        top = max(f[0] for f in found)
        alike = [f for f in found if f[0] == top]
        return min(f[2] for f in alike), min(100, top), any(f[3] for f in alike), sum(f[1] for f in alike) > 1


def _allocate(facts: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
    pool, out = Pool(rows), []
    for r in facts.sort_values(["order", "processor_payment_id"]).itertuples():
        n = pool.count[()]
        hit = pool.best(None if pd.isna(r.day) else int(r.day), None if pd.isna(r.email) else r.email)
        if hit is None:
            out.append((r.workspace_id, r.processor_payment_id, None, 0, "none", False, 0))
            continue
        id_, score, identity, tie = hit
        if not tie:
            pool.take(id_)
        out.append((r.workspace_id, r.processor_payment_id, id_, score, "high" if score >= 80 and identity else "medium" if score >= 50 else "low", tie, n))
    return pd.DataFrame(out, columns=["workspace_id", "processor_payment_id", "accounting_id", "score", "level", "has_tie", "n_candidates"])


def exact(proc: DataFrame, acct: DataFrame) -> DataFrame:
    """Payments whose id a row refers to, whatever its amount: score 100, no candidates for review. Of several rows the oldest."""
    return by_reference(proc, acct).select("workspace_id", "processor_payment_id", "accounting_id", F.lit(100).alias("score"), F.lit("high").alias("level"), F.lit(False).alias("has_tie"), F.lit(0).cast("long").alias("n_candidates"))


def run(proc: DataFrame, acct: DataFrame) -> DataFrame:
    """One row per payment: accounting_id, score, level (high, medium, low, none), has_tie (the row stays free, a review decides), n_candidates (rows that were free)."""
    hits = exact(proc, acct)
    email = F.lower(S.blank_to_null(F.col("customer_email"))).alias("email")
    day = F.unix_date("proc_date")
    facts = proc.join(hits.select("workspace_id", "processor_payment_id"), ["workspace_id", "processor_payment_id"], "left_anti")
    facts = facts.select("workspace_id", F.col("amount_gross").alias("amount"), "processor_payment_id", day.alias("day"), F.coalesce(-day, F.lit(1 << 30)).alias("order"), email)
    rows = acct.join(hits.select("workspace_id", "accounting_id"), ["workspace_id", "accounting_id"], "left_anti")
    rows = rows.select("workspace_id", F.col("amount_gross").alias("amount"), "accounting_id", F.unix_date("acct_date").alias("acct_day"), email)
    found = facts.groupBy(*BLOCK).cogroup(rows.groupBy(*BLOCK)).applyInPandas(_allocate, _OUT)
    return hits.unionByName(found)
