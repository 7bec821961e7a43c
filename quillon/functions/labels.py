"""Fixed tables as columns: gateway states, error classes, versions, zones, stamps, licence and sync gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Gateway transaction state and the kind of fact it makes.
GATEWAY_STATES = {
    "settledSuccessfully": "payment", "capturedPendingSettlement": "payment", "authorizedPendingCapture": "payment",
    "refundSettledSuccessfully": "refund", "refundPendingSettlement": "refund", "returnedItem": "ach_return",
    "chargeback": "chargeback", "chargebackPending": "chargeback", "voided": "voided",
    "declined": "declined", "expired": "declined", "failedReview": "declined",
}


# Gateway states that count as settled.
SETTLED = ("settledSuccessfully", "refundSettledSuccessfully")

# Words that decide an error's class, in the order in which classes are tried.
ERROR_WORDS = {
    "authorization": ("oauth", "unauthorized", "401", "token", "authentication", "access denied", "forbidden", "403", "invalid_grant", "refresh token", "expired token", "invalid_client", "token_revoked", "authorization_revoked"),
    "configuration": ("configuration", "not configured", "missing required", "account not found", "invalid account", "realm not found", "company not found", "missing company"),
    "data_integrity": ("mismatch", "duplicate", "integrity", "constraint", "validation", "does not match", "inconsistent", "already exists", "violation"),
}

# Time zones of states and provinces, by country.
ZONES = {
    "CA": {"BC": "America/Vancouver", "AB": "America/Edmonton", "SK": "America/Regina", "MB": "America/Winnipeg", "ON": "America/Toronto", "QC": "America/Toronto", "NB": "America/Halifax", "NS": "America/Halifax", "PE": "America/Halifax", "NL": "America/St_Johns", "YT": "America/Whitehorse", "NT": "America/Yellowknife", "NU": "America/Iqaluit"},
    "AU": {"NSW": "Australia/Sydney", "VIC": "Australia/Melbourne", "QLD": "Australia/Brisbane", "WA": "Australia/Perth", "SA": "Australia/Adelaide", "TAS": "Australia/Hobart", "ACT": "Australia/Sydney", "NT": "Australia/Darwin"},
}
COUNTRY_ZONES = {"CA": "America/Toronto", "AU": "Australia/Sydney", "GB": "Europe/London"}


def error_class(text: Column) -> Column:
    """The class of an error's text: the first whose words it holds; what none claims is of the infrastructure, and may be tried again."""
    out = F.lit("infrastructure")
    for name, words in reversed(ERROR_WORDS.items()):
        holds = F.lit(False)
        for w in words:
            holds = holds | F.contains(F.lower(text), F.lit(w))
        out = F.when(holds, name).otherwise(out)
    return out


def zone(country: Column, state: Column) -> Column:
    """The time zone of a state or province, else of its country, else New York's."""
    at = F.upper(F.trim(state))
    own = F.when(country == "CA", lookup(ZONES["CA"], at)).when(country == "AU", lookup(ZONES["AU"], at))
    return F.coalesce(own, lookup(COUNTRY_ZONES, country), F.lit("America/New_York"))


def is_fee(description: Column) -> Column:
    """Whether a bank transfer is a fee, by words of its description."""
    return F.lower(description).rlike("fee|discount|adjustment|service charge")


def clean_metadata(meta: Column) -> Column:
    """A map without the keys that belong to matching and status."""
    return F.map_filter(meta, lambda k, _: ~(k.startswith("qbo_") | k.startswith("match_") | k.isin("status", "ready", "readiness", "confidence", "needs_review")))


def amount_key(amount: Column) -> Column:
    return F.abs(amount).cast("decimal(18,2)").cast("string")


def full_name(first: Column, last: Column) -> Column:
    return F.nullif(F.trim(F.concat_ws(" ", first, last)), F.lit(""))


def stream_start(cursor: Column, new: Column, today: Column) -> Column:
    """The day from which a source is read: its cursor, or 62 days back for a new source, 7 for one whose cursor is lost."""
    return F.coalesce(cursor, F.when(new, F.date_sub(today, 62)).otherwise(F.date_sub(today, 7)))


def transfer_start(starts: Column, today: Column) -> Column:
    """Bank transfers settle late, so they are read 14 days back at least."""
    return F.least(starts, F.date_sub(today, 14))


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    return found if default is None else F.coalesce(found, default)


def gateway_kind(state: Column) -> Column:
    return lookup(GATEWAY_STATES, state, F.lit("payment"))


def signed_amount(kind: Column, amount: Column) -> Column:
    return F.when(kind == "payment", amount).when(kind.isin("refund", "ach_return"), -amount).otherwise(0)


def version_key(version: Column) -> Column:
    """Major, minor and patch as an array of numbers; anything but digits in a part is dropped."""
    parts = F.split(version, r"\.")
    part = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.array(*[F.coalesce(F.nullif(F.regexp_replace(part(i), "[^0-9]", ""), F.lit("")).cast("int"), F.lit(0)) for i in (1, 2, 3)])


def deposit_stamp(payout_id: Column) -> Column:
    return F.concat(F.lit("By quillon-"), F.right(payout_id, F.lit(8)))


def licence_valid(status: Column, starts: Column, ends: Column, now: Column) -> Column:
    return (status == "active") & F.coalesce(starts <= now, F.lit(True)) & F.coalesce(ends > now, F.lit(True))


def health(total: Column, success: Column, stale: Column, failures: Column) -> Column:
    ratio = success / F.nullif(total, F.lit(0)) - F.when(stale, 0.2).otherwise(0.0) - F.least(F.lit(0.3), 0.1 * failures)
    return F.when(total == 0, 1.0).otherwise(F.round(F.greatest(F.lit(0.0), ratio), 2))


def terminal_state(processed: Column, failed: Column, ambiguous: Column, warnings: Column) -> Column:
    return F.when((failed > 0) & (processed > 0), "partially_completed").when(failed > 0, "failed").when(ambiguous > 0, "completed_with_ambiguity").when(warnings > 0, "completed_with_warnings").otherwise("completed")


# Abbreviations of time zones by their minutes from UTC.
ZONE_ABBREVIATIONS = {
    "America/New_York": {-300: "EST", -240: "EDT"}, "America/Toronto": {-300: "EST", -240: "EDT"}, "America/Chicago": {-360: "CST", -300: "CDT"}, "America/Denver": {-420: "MST", -360: "MDT"},
    "America/Phoenix": {-420: "MST"}, "America/Los_Angeles": {-480: "PST", -420: "PDT"}, "America/Vancouver": {-480: "PST", -420: "PDT"}, "America/Halifax": {-240: "AST", -180: "ADT"},
    "America/St_Johns": {-210: "NST", -150: "NDT"}, "Europe/London": {0: "GMT", 60: "BST"}, "Australia/Sydney": {600: "AEST", 660: "AEDT"}, "Australia/Brisbane": {600: "AEST"},
    "Australia/Adelaide": {570: "ACST", 630: "ACDT"}, "Australia/Darwin": {570: "ACST"}, "Australia/Perth": {480: "AWST"},
}


def zone_abbreviation(zone: Column, at: Column, local_at: Column) -> Column:
    """The abbreviation of a zone at a time, from the distance of its local time; UTC and hours where there is none."""
    minutes = F.round((F.unix_timestamp(local_at) - F.unix_timestamp(at)) / 60).cast("int")
    known = F.create_map(*[F.lit(x) for z, of in ZONE_ABBREVIATIONS.items() for m, name in of.items() for x in (f"{z}:{m}", name)])
    return F.coalesce(F.element_at(known, F.concat_ws(":", zone, minutes.cast("string"))), F.format_string("UTC%+d", F.floor(minutes / 60).cast("int")))
