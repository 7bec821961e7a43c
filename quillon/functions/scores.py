"""Match scores as columns. The points are fixed values; the three strategies differ and all stay."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def date_points(days: Column) -> Column:
    """Accounting date less processor date: full points up to three days later, fewer before or after."""
    return F.when(days.between(0, 3), 25).when(days.between(4, 7), 12).when(days == -1, 10).when(days.between(-7, -2), 5).otherwise(0)


def date_points_symmetric(days: Column) -> Column:
    return F.when(F.abs(days) <= 3, 25).when(F.abs(days) <= 7, 12).otherwise(0)


def name_tokens(name: Column) -> Column:
    return F.array_sort(F.filter(F.split(F.regexp_replace(F.lower(name), ",", " "), r"\s+"), lambda t: t != ""))


def identity_keys(email: Column, name: Column) -> Column:
    """What identity_points compares, worked out once a row and not once a pair: e-mail, name, and sorted words of names of two or more."""
    e, n = (F.lower(blank_to_null(c)) for c in (email, name))
    return F.struct(e.alias("email"), n.alias("name"), F.when(F.size(name_tokens(n)) >= 2, F.array_join(name_tokens(n), " ")).alias("words"))


def points_of(a: Column, b: Column) -> Column:
    """25 for equal e-mail, name or name words in any order (two or more); 12 if one name holds the other. From identity_keys of both sides."""
    return F.when(a["email"] == b["email"], 25).when(a["name"] == b["name"], 25).when(a["words"] == b["words"], 25).when(F.contains(a["name"], b["name"]) | F.contains(b["name"], a["name"]), 12).otherwise(0)


#: Letters of the pieces that marks tells of a name.
HELD = 3


def marks(keys: Column, names: tuple[str, ...]) -> Column:
    """Of identity_keys those in names, each with its hash, and a name also with 64 bits for its pieces: for likely_points, which looks at texts only where these agree."""
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(F.substring(keys["name"], i, HELD)), F.lit(64)).cast("int"))
    n = F.length(keys["name"]) - HELD + 1
    pieces = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0).cast("long"), lambda bits, i: bits.bitwiseOR(bit(i)))).when(n <= 0, F.lit(0).cast("long"))
    hashed = [F.when(keys[k].isNotNull(), F.xxhash64(keys[k])).alias(f"{k}_hash") for k in names]
    return F.struct(*[keys[k].alias(k) for k in names], *hashed, *([pieces.alias("pieces")] if "name" in names else []))


def same(a: Column, b: Column, key: str) -> Column:
    """Whether a key of both marks is equal; null where one has none."""
    return (a[f"{key}_hash"] == b[f"{key}_hash"]) & (a[key] == b[key])


def likely_points(a: Column, b: Column) -> Column:
    """points_of, from marks of both sides: a name that holds another has all pieces of it."""
    holds = lambda x, y: (x["pieces"].bitwiseAND(y["pieces"]) == y["pieces"]) & F.contains(x["name"], y["name"])
    return F.when(same(a, b, "email"), 25).when(same(a, b, "name"), 25).when(same(a, b, "words"), 25).when(holds(a, b) | holds(b, a), 12).otherwise(0)


def identity_points(email_a: Column, email_b: Column, name_a: Column, name_b: Column) -> Column:
    return points_of(identity_keys(email_a, name_a), identity_keys(email_b, name_b))


def inside(days: Column, width: int) -> Column:
    """Whether a difference of days is within the width; an unknown one counts as inside."""
    return F.coalesce(F.abs(days) <= width, F.lit(True))


def email_points(email_a: Column, email_b: Column, points: int) -> Column:
    return F.when(F.lower(blank_to_null(email_a)) == F.lower(blank_to_null(email_b)), points).otherwise(0)


def level(score: Column, high: int) -> Column:
    return F.when(score >= high, "high").when(score >= 50, "medium").otherwise("low")


def refs_conflict(txn: Column, ref: Column) -> Column:
    return F.coalesce(blank_to_null(txn) != blank_to_null(ref), F.lit(False))


def fee_points(fee: Column) -> Column:
    """Points for the fee that a deposit would imply."""
    return F.when(fee < 0, 0.0).when(fee <= 10, 100.0).when(fee <= 25, 90.0).when(fee <= 50, 75.0).when(fee <= 100, 60.0).otherwise(F.greatest(F.lit(0.0), F.lit(50.0) - (fee.cast("double") - 100)))


def lag_points(days: Column) -> Column:
    return F.when(days < 0, 0.0).when(days.between(5, 10), 100.0).when(days.between(3, 14), 80.0).when(days.between(1, 20), 50.0).otherwise(20.0)


def rarity_points(n: Column) -> Column:
    return F.when(n == 1, 100.0).when(n == 2, 50.0).otherwise(20.0)
