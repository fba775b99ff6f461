"""How the fields of the chain tables are read, as Spark columns and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"
ZERO_HASH = "0" * 64
#: Epoch values from here on are milliseconds, and from here times 1000 microseconds.
MILLIS_FROM = 100_000_000_000

# Each function takes a column's name and hands Spark one expression as text, which is parsed once where building it from columns takes
# dozens of calls.
_BLANKS = r"' \t\r\n'"


def _clean_hash(c: str) -> str:
    return f"regexp_replace(lower(btrim({c}, {_BLANKS})), '^0x', '')"


def _real_hash(c: str) -> str:
    return f"regexp_replace(lower(btrim({c}, {_BLANKS})), '^(?:0x)?(?:0{{64}}$)?', '')"


def _hash_bytes(h: str) -> str:
    text = f"encode(concat(if(octet_length({h}) = 31, '!!', '?'), {h}), 'UTF-8')"
    return f"CASE WHEN length({h}) = 64 THEN coalesce(unhex({h}), {text}) WHEN length({h}) > 0 THEN {text} END"


def clean_hash(c: str) -> Column:
    """A hash as lower-case hex without blanks and 0x; null stays null, blank gives the empty string."""
    return F.expr(_clean_hash(c))


def real_hash(c: str) -> Column:
    """clean_hash, with the empty string also for the all-zero hash, which refers to nothing."""
    return F.expr(_real_hash(c))


def hash_bytes(c: str) -> Column:
    """The 32 bytes of a cleaned hash; of other text its UTF-8 bytes behind a sign, so that they are never 32; null for null and empty."""
    return F.expr(_hash_bytes(c))


def hash_of(c: str) -> Column:
    """hash_bytes of a hash as it stands. 64 hex digits, as nearly all hashes are, need no cleaning."""
    return F.expr(f"coalesce(CASE WHEN octet_length({c}) = 64 THEN unhex({c}) END, {_hash_bytes(_clean_hash(c))})")


def real_hash_of(c: str) -> Column:
    """hash_of, with null also for the all-zero hash, which refers to nothing."""
    return F.expr(f"coalesce(CASE WHEN octet_length({c}) = 64 AND {c} <> '{ZERO_HASH}' THEN unhex({c}) END, {_hash_bytes(_real_hash(c))})")


def hash_text(c: str) -> Column:
    """The cleaned text that hash_bytes had."""
    return F.expr(f"CASE WHEN octet_length({c}) = 32 THEN lower(hex({c})) WHEN substring({c}, 1, 2) = X'2121' THEN cast(substring({c}, 3) AS string) ELSE cast(substring({c}, 2) AS string) END")


def clean_address(c: str) -> Column:
    """An address without blanks, bc1 forms in lower case; null where there is none.

    Few addresses have blanks other than spaces around them; only those take the slower way.
    """
    odd = " OR ".join(f"{f}(trim({c}), '{x}')" for x in (r"\t", r"\r", r"\n") for f in ("startswith", "endswith"))
    t = f"CASE WHEN {odd} THEN btrim({c}, {_BLANKS}) ELSE trim({c}) END"
    return F.expr(f"nullif(CASE WHEN lower(substring({t}, 1, 3)) = 'bc1' THEN lower({t}) ELSE {t} END, '')")


def clean_name(c: str) -> Column:
    """A coin or source name without blanks and in lower case; blank gives null."""
    return F.expr(f"nullif(lower(btrim({c}, {_BLANKS})), '')")


def _epoch_seconds(c: str) -> str:
    return f"CASE WHEN {c} <= 0 THEN NULL WHEN {c} >= {MILLIS_FROM * 1000} THEN {c} DIV 1000000 WHEN {c} >= {MILLIS_FROM} THEN {c} DIV 1000 ELSE {c} END"


def epoch_seconds(c: str) -> Column:
    """Block time in seconds; null for null, zero and negative values."""
    return F.expr(f"cast({_epoch_seconds(c)} AS bigint)")


def epoch_day(c: str) -> Column:
    """The UTC date of a block time."""
    return F.expr(f"to_date(timestamp_seconds({_epoch_seconds(c)}))")


_SQL_BLANKS = "' ' || chr(9) || chr(13) || chr(10)"


def sql_hash(c: str) -> str:
    return f"nullif(regexp_replace(lower(trim({c}, {_SQL_BLANKS})), '^0x', ''), '')"


def sql_real_hash(c: str) -> str:
    return f"nullif({sql_hash(c)}, '{ZERO_HASH}')"


def sql_address(c: str) -> str:
    t = f"trim({c}, {_SQL_BLANKS})"
    return f"nullif(CASE WHEN lower({t}) LIKE 'bc1%' THEN lower({t}) ELSE {t} END, '')"


def sql_name(c: str) -> str:
    return f"nullif(lower(trim({c}, {_SQL_BLANKS})), '')"


def sql_day(c: str) -> str:
    return (
        f"CAST(to_timestamp(CASE WHEN {c} <= 0 THEN NULL WHEN {c} >= {MILLIS_FROM * 1000} THEN {c} // 1000000"
        f" WHEN {c} >= {MILLIS_FROM} THEN {c} // 1000 ELSE {c} END) AT TIME ZONE 'UTC' AS DATE)"
    )
