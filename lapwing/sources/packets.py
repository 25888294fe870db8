"""Packet records: classification, the fixed identification record, comments and audio preludes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapwing.functions.signal import ilog

#: First byte of each header kind, and the six bytes that follow it.
HEADER_KINDS = {1: "identification", 3: "comment", 5: "setup"}
MAGIC = "vorbis"


def byte_at(data: Column, place: int) -> Column:
    """The unsigned byte at a place from 0, null past the end."""
    return F.conv(F.nullif(F.hex(F.substring(data, place + 1, 1)), F.lit("")), 16, 10).cast("long")


def little_endian(data: Column, place: int, size: int) -> Column:
    """The unsigned number in size bytes, least significant first."""
    return sum((byte_at(data, place + k) * F.lit(1 << 8 * k) for k in range(1, size)), byte_at(data, place))


def packet_kind(data: Column) -> Column:
    """audio if the first bit is 0; a header's kind if its byte and magic are right; null for anything else or no bytes."""
    first = byte_at(data, 0)
    kind = F.create_map(*[F.lit(x) for k, v in HEADER_KINDS.items() for x in (k, v)])
    is_header = F.substring(data, 2, 6) == F.encode(F.lit(MAGIC), "utf-8")
    return F.when(first.bitwiseAND(F.lit(1)) == 0, F.lit("audio")).when(is_header, F.element_at(kind, first.cast("int")))


def identification(data: Column) -> Column:
    """The identification record as a struct, null where it breaks a rule: 30 bytes, version 0, channels and rate above 0,
    block exponents 6 to 13 in order, framing bit set."""
    low, high = byte_at(data, 28).bitwiseAND(F.lit(15)), F.shiftright(byte_at(data, 28), 4)
    version, channels, rate = little_endian(data, 7, 4), byte_at(data, 11), little_endian(data, 12, 4)
    signed = lambda x: F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)
    valid = (F.octet_length(data) >= 30) & (packet_kind(data) == "identification") & (version == 0) & (channels > 0) & (rate > 0) & low.between(6, 13) & high.between(6, 13) & (low <= high) & (byte_at(data, 29).bitwiseAND(F.lit(1)) == 1)
    size = lambda x: F.shiftleft(F.lit(1), x.cast("int"))
    return F.when(valid, F.struct(channels.cast("int").alias("channels"), rate.alias("sample_rate"), *[signed(little_endian(data, 16 + 4 * k, 4)).alias(f"bitrate_{n}") for k, n in enumerate(("maximum", "nominal", "minimum"))], F.expr("1").alias("framing"), low.cast("int").alias("exponent_0"), high.cast("int").alias("exponent_1")))


def write_identification(channels: Column, rate: Column, nominal: Column, exponent_0: Column, exponent_1: Column) -> Column:
    """The inverse record, as binary: bitrate bounds unset."""
    number = lambda x, size: [F.lpad(F.hex(F.shiftright(x.cast("long"), 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(size)]
    parts = [F.lit("01"), F.hex(F.encode(F.lit(MAGIC), "utf-8")), F.lit("00000000"), *number(channels, 1), *number(rate, 4), F.lit("00000000"), *number(nominal, 4), F.lit("00000000"), *number(exponent_0 + exponent_1 * 16, 1), F.lit("01")]
    return F.unhex(F.concat(*parts))


def prelude(bits: Column, modes: int) -> Column:
    """Type bit, mode of ilog(modes - 1) bits, and for modes of long blocks (odd ones here) two window flags, read from the lowest bit up."""
    width = ilog(modes - 1)
    mode = F.shiftright(bits, 1).bitwiseAND(F.lit((1 << width) - 1))
    long_block = mode % 2 == 1
    flag = lambda k: F.when(long_block, F.shiftright(bits, 1 + width + k).bitwiseAND(F.lit(1)).cast("int"))
    return F.struct(bits.bitwiseAND(F.lit(1)).cast("int").alias("kind"), mode.cast("int").alias("mode"), long_block.alias("blockflag"), flag(0).alias("previous"), flag(1).alias("next"))


def key_values(rows: DataFrame, key: str, entries: Column) -> DataFrame:
    """(key, name, value) of entries that hold '='; they part at the first, and names may repeat."""
    exploded = rows.select(key, F.explode(entries).alias("entry")).where(F.instr("entry", "=") > 0)
    parts = F.split("entry", "=", 2)
    return exploded.select(key, F.get(parts, 0).alias("name"), F.get(parts, 1).alias("value"))


def lacing(size: Column) -> Column:
    """How many bytes a length takes in 255-runs, and the last of them."""
    return F.struct((F.expr("1") + F.floor(size / 255)).cast("long").alias("lacing_bytes"), (size % 255).cast("long").alias("last_byte"))
