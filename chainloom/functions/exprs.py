"""Scalar functions of the chain as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

COIN_UNITS = 100_000_000
HALVING = 210_000
FIRST_REWARD = 50 * COIN_UNITS


def double_sha256(data: Column) -> Column:
    """Lower-case hex of the double SHA-256 of a binary column."""
    return F.sha2(F.unhex(F.sha2(data, 256)), 256)


def reverse_hex(h: Column) -> Column:
    """Hex text with its bytes in reverse order; the customary display of a hash. A last half byte is left out."""
    whole = F.substring(h, F.lit(1), F.length(h) - F.length(h) % 2)
    return F.regexp_replace(F.reverse(whole), "(.)(.)", "$2$1")


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def from_hex(h: Column) -> Column:
    """Bytes of hex text; null for odd lengths and other characters."""
    return F.when(F.length(h) % 2 == 0, F.unhex(h))


def base_reward(height: Column) -> Column:
    """Mining reward at a height, halved every 210,000 blocks; 0 from the 64th halving on."""
    halvings = F.floor(height / HALVING).cast("int")
    return F.when(halvings < 63, F.call_function("shiftright", F.lit(FIRST_REWARD).cast("bigint"), halvings)).otherwise(F.lit(0).cast("bigint"))


def target(bits: Column) -> Column:
    """Difficulty target of the compact form: its low three bytes times 256 to the power of the high byte minus 3."""
    low = F.lit(1 << 24)
    return (bits % low).cast("double") * F.pow(F.lit(256.0), F.floor(bits / low) - 3)


def little_endian(n: Column, size: int) -> Column:
    """Hex of the low `size` bytes of an integer, lowest first."""
    return reverse_hex(F.lower(F.right(F.lpad(F.hex(n), 16, "0"), F.lit(2 * size))))


def header_hex(version: Column, prev: Column, merkle: Column, time: Column, bits: Column, nonce: Column) -> Column:
    """Hex of the 80 bytes of a block header; prev and merkle as displayed."""
    return F.concat(little_endian(version, 4), reverse_hex(prev), reverse_hex(merkle), *[little_endian(c, 4) for c in (time, bits, nonce)])


def compact_size(data: Column) -> Column:
    """Value of the CompactSize at the start of a binary column as DECIMAL(20,0); null where bytes are missing."""
    h = F.lower(F.hex(data))
    first = F.substring(h, 1, 2)

    def wide(size: int) -> Column:
        return F.when(F.length(h) >= 2 + 2 * size, F.conv(reverse_hex(F.substring(h, 3, 2 * size)), 16, 10))

    text = F.when(first == "fd", wide(2)).when(first == "fe", wide(4)).when(first == "ff", wide(8)).otherwise(F.conv(first, 16, 10))
    return text.cast("decimal(20,0)")


def compact_width(n: Column) -> Column:
    """Bytes of the shortest CompactSize of a length."""
    return F.when(n < 0xFD, 1).when(n < 1 << 16, 3).when(n < 1 << 32, 5).otherwise(9)


def compact_hex(n: Column) -> Column:
    """Hex of the shortest CompactSize of a length."""
    widths = ((0xFD, "", 1), (1 << 16, "fd", 2), (1 << 32, "fe", 4))
    out = F
    for limit, mark, size in widths:
        out = out.when(n < limit, F.concat(F.lit(mark), little_endian(n, size)))
    return out.otherwise(F.concat(F.lit("ff"), little_endian(n, 8)))


def input_hex(prev: Column, index: Column, script: Column, sequence: Column) -> Column:
    """Hex of a transaction's input; prev as displayed, a missing outpoint as zeros."""
    size = F.coalesce(F.octet_length(script), F.lit(0)).cast("bigint")
    return F.concat(F.coalesce(reverse_hex(prev), F.lit("0" * 64)), little_endian(F.coalesce(index, F.lit(0)), 4), compact_hex(size), F.coalesce(to_hex(script), F.lit("")), little_endian(F.coalesce(sequence, F.lit(0)), 4))


def output_hex(value: Column, script: Column) -> Column:
    """Hex of a transaction's output; a missing value as zero."""
    size = F.coalesce(F.octet_length(script), F.lit(0)).cast("bigint")
    return F.concat(little_endian(F.coalesce(value, F.lit(0)).cast("bigint"), 8), compact_hex(size), F.coalesce(to_hex(script), F.lit("")))


def merkle_of(hashes: Column) -> Column:
    """Displayed merkle root of an array of displayed hashes in order; null for an empty one. A block bounds the array."""
    inner = F.transform(hashes, lambda h: F.unhex(reverse_hex(h)))
    levels = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(F.greatest(F.size(hashes), F.lit(1)).cast("double"))).cast("int"), F.lit(1)))

    def up(level: Column, _: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.floor((F.size(level) - 1) / 2).cast("int"))
        joined = F.transform(pairs, lambda k: F.unhex(double_sha256(F.concat(F.get(level, k * 2), F.coalesce(F.get(level, k * 2 + 1), F.get(level, k * 2))))))
        return F.when(F.size(level) > 1, joined).otherwise(level)

    return F.when(F.size(hashes) > 0, reverse_hex(F.lower(F.hex(F.get(F.aggregate(levels, inner, up), 0)))))


def register_sql(spark: SparkSession) -> None:
    """SQL functions: target(bits), base_reward(height), dsha256(data), hash_display(hex)."""
    for name, args, body in (
        ("target", "bits BIGINT", "CAST(bits % 16777216 AS DOUBLE) * pow(256D, bits DIV 16777216 - 3)"),
        ("base_reward", "height BIGINT", f"IF(height DIV {HALVING} < 63, shiftright({FIRST_REWARD}L, CAST(height DIV {HALVING} AS INT)), 0L)"),
        ("dsha256", "data BINARY", "sha2(unhex(sha2(data, 256)), 256)"),
        ("hash_display", "h STRING", "array_join(reverse(regexp_extract_all(h, '(..)', 1)), '')"),
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURN {body}")
