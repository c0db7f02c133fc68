"""160-bit keys and fixed-stride binary data as columns; keys are 40 hexadecimal digits, lower case."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOOM_BITS, BLOOM_HASHES = 2048, 2


def parse_id(text: Column) -> Column:
    """40 hexadecimal digits, with or without 0x before them, as a key; null for anything else."""
    digits = F.lower(F.regexp_replace(F.trim(text), "^0[xX]", ""))
    return F.when(digits.rlike(r"^[0-9a-f]{40}\z"), digits)


def parse_info_hash(text: Column) -> Column:
    """A key, bare or behind urn:btih: or btih:."""
    digits = F.lower(F.regexp_replace(F.trim(text), r"^(?i)(?:urn:)?btih:", ""))
    return F.when(digits.rlike(r"^[0-9a-f]{40}\z"), digits)


def byte_at(key: Column, k: int) -> Column:
    return F.conv(F.substring(key, 2 * k + 1, 2), 16, 10).cast("int")


def xor(a: Column, b: Column) -> Column:
    """The distance of two keys, as a key; string order is numeric order. Works on four words of 40 bits."""
    word = lambda x, k: F.conv(F.substring(x, 10 * k + 1, 10), 16, 10).cast("long")
    return F.concat(*[F.lpad(F.lower(F.hex(word(a, k).bitwiseXOR(word(b, k)))), 10, "0") for k in range(4)])


def leading_zeros(key: Column) -> Column:
    """Zero bits before the first one; 160 for the zero key."""
    digits = F.regexp_extract(key, "^0*", 0)
    first = F.substring(key, F.length(digits) + 1, F.lit(1))
    extra = F.when(first == "", 0).when(first == "1", 3).when(first.isin("2", "3"), 2).when(first.isin("4", "5", "6", "7"), 1).otherwise(0)
    return (F.length(digits) * 4 + extra).cast("int")


def bit_length(key: Column) -> Column:
    return F.lit(160) - leading_zeros(key)


def get_bit(key: Column, place: int) -> Column:
    """A bit, the highest being 0."""
    return F.shiftright(byte_at(key, place // 8), 7 - place % 8).bitwiseAND(F.lit(1)).cast("int")


def set_bit(key: Column, place: int, on: bool = True) -> Column:
    """The key with one bit set or cleared, the highest being 0."""
    mask = 128 >> place % 8
    byte = byte_at(key, place // 8)
    changed = byte.bitwiseOR(F.lit(mask)) if on else byte.bitwiseAND(F.lit(255 - mask))
    return F.overlay(key, F.lpad(F.lower(F.hex(changed)), 2, "0"), F.lit(2 * (place // 8) + 1))


def announced_port(implied: Column, port: Column, source_port: Column) -> Column:
    """The port of an announce: that which it came from if it says so, else the one it names."""
    return F.when(F.coalesce(implied, F.lit(0)) != 0, source_port).otherwise(port)


def unsigned(hexed: Column) -> Column:
    return F.conv(hexed, 16, 10).cast("long")


def strides(hexed: Column, size: int) -> Column:
    """The whole entries of size bytes in a hexadecimal string, in order."""
    n = F.floor(F.length(hexed) / (2 * size)).cast("int")
    spots = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(spots, lambda i: F.substring(hexed, i * (2 * size) + 1, F.lit(2 * size)))


def ipv4(hexed: Column) -> Column:
    return F.concat_ws(".", *[byte_at(hexed, k).cast("string") for k in range(4)])


def compact_peers(hexed: Column) -> Column:
    """array<struct<ip, port>> of entries of four address bytes and two port bytes, high byte first."""
    return F.transform(strides(hexed, 6), lambda e: F.struct(ipv4(e).alias("ip"), unsigned(F.substring(e, 9, 4)).cast("int").alias("port")))


def compact_nodes(hexed: Column) -> Column:
    """array<struct<id, ip, port>> of entries of 26 bytes."""
    return F.transform(strides(hexed, 26), lambda e: F.struct(F.substring(e, 1, 40).alias("id"), ipv4(F.substring(e, 41, 8)).alias("ip"), unsigned(F.substring(e, 49, 4)).cast("int").alias("port")))


def compact_nodes_ipv6(hexed: Column) -> Column:
    """array<struct<id, ip, port>> of entries of 38 bytes; addresses as 32 hexadecimal digits."""
    return F.transform(strides(hexed, 38), lambda e: F.struct(F.substring(e, 1, 40).alias("id"), F.substring(e, 41, 32).alias("ip"), unsigned(F.substring(e, 73, 4)).cast("int").alias("port")))


def scrape_entries(hexed: Column) -> Column:
    """array<struct<seeders, completed, leechers>> of a datagram: eight bytes of head, then twelve for each asked hash."""
    body = F.substring(hexed, 17, F.length(hexed))
    part = lambda e, k: unsigned(F.substring(e, 8 * k + 1, 8)).cast("int")
    return F.transform(strides(body, 12), lambda e: F.struct(part(e, 0).alias("seeders"), part(e, 1).alias("completed"), part(e, 2).alias("leechers")))


def bloom_places(ip_hex: Column) -> Column:
    """The two bits that an address sets: the first four bytes of its digest, low byte first in each pair."""
    digest = F.sha1(F.unhex(ip_hex))
    pair = lambda k: (byte_at(digest, k).bitwiseOR(F.shiftleft(byte_at(digest, k + 1), 8)) % BLOOM_BITS).cast("int")
    return F.array(pair(0), pair(2))


def bloom_filter(place: Column) -> Column:
    """Aggregate: the filter in which all places are set, 32 numbers of 64 bits."""
    word, bit = F.floor(place / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return F.array(*[F.coalesce(F.bit_or(F.when(word == k, bit)), F.lit(0).cast("long")) for k in range(BLOOM_BITS // 64)])


def bloom_merged(held: Column) -> Column:
    """Aggregate: the filter of all that the filters of a group hold."""
    return F.array(*[F.coalesce(F.bit_or(held[k]), F.lit(0).cast("long")) for k in range(BLOOM_BITS // 64)])


def bloom_union(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.bitwiseOR(y))


def bloom_has(held: Column, places: Column) -> Column:
    """Whether an address may be in a filter: all its places are set."""
    return F.forall(places, lambda p: F.call_function("shiftright", F.element_at(held, F.floor(p / 64).cast("int") + 1), (p % 64).cast("int")).bitwiseAND(F.lit(1)) == 1)


def bloom_bits(held: Column) -> Column:
    return F.aggregate(held, F.lit(0), lambda n, x: n + F.bit_count(x))


def bloom_estimate(bits_set: Column) -> Column:
    """Distinct addresses behind a filter in which so many bits are set; a full filter sets no bound, its estimate is infinite."""
    zeros = F.least(F.lit(BLOOM_BITS) - bits_set, F.lit(BLOOM_BITS - 1))
    return F.when(zeros == 0, F.lit(math.inf)).otherwise(F.log(zeros / BLOOM_BITS) / (BLOOM_HASHES * math.log(1 - 1 / BLOOM_BITS)))


def announce_token(secret: str, node: Column, info_hash: Column, peer: Column, addr: Column) -> Column:
    return F.md5(F.concat(F.encode(F.lit(secret), "UTF-8"), F.unhex(node), F.unhex(info_hash), F.unhex(peer), F.encode(addr, "UTF-8")))


def with_client_marker(key: Column, prefix_hex: str, suffix_hex: str = "") -> Column:
    """The key with its first and last bytes replaced by a client's marker."""
    kept = F.overlay(key, F.lit(prefix_hex), F.lit(1)) if prefix_hex else key
    return F.overlay(kept, F.lit(suffix_hex), F.lit(41 - len(suffix_hex))) if suffix_hex else kept
