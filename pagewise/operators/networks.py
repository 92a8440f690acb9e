"""Addresses against a table of networks, both families, as equi-joins.

An address is its family and bits (as hex digits). A network of prefix length L
holds an address if their first L bits are equal, so for every prefix length that
the table uses, an address has one key, and a key of the network is the same. Each
address meets the table once per used length (at most 33 + 129), whatever the
number of networks; there is no range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewise.functions import urls as U
from pagewise.functions.html import bind


def _v4_hex(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 8, "0"))


def _v6_hex(ip: Column) -> Column:
    """32 hex digits of an IPv6 literal (``::``, an IPv4 tail and a zone allowed), NULL if it is none."""
    tail = F.regexp_extract(ip, r"^[0-9a-f:]*:([0-9]+(?:\.[0-9]+){3})$", 1)
    tail_hex = _v4_hex(U.ipv4_to_long(tail))
    head = F.substring(ip, F.lit(1), F.length(ip) - F.length(tail))
    plain = F.when(tail == "", ip).when(tail_hex.isNotNull(), F.concat(
        head, F.substring(tail_hex, 1, 4), F.lit(":"), F.substring(tail_hex, 5, 4)))

    def groups(x: Column) -> Column:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.split(x, ":", -1))

    def expand(halves: Column) -> Column:
        left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
        given = F.size(left) + F.size(right)
        zeros = F.array_repeat(F.lit("0"), F.greatest(8 - given, F.lit(0)))
        whole = F.when((F.size(halves) == 1) & (given == 8), left).when((F.size(halves) == 2) & (given < 8), F.concat(left, zeros, right))
        good = F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(good, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))
    return F.when(ip.contains(":"), bind(F.split(plain, "::", -1), expand))


def address_bits(ip: Column) -> Column:
    """``(family, bits)``: 4 with 8 hex digits, 6 with 32; NULL if ``ip`` is no address. An
    IPv4-mapped IPv6 address counts as the IPv4 address that it stands for."""
    v4 = U.ipv4_to_long(ip)

    def of(six: Column) -> Column:
        mapped = six.startswith("0" * 20 + "ffff")
        return F.when(mapped, F.struct(F.lit(4).alias("family"), F.substring(six, 25, 8).alias("bits"))).when(
            six.isNotNull(), F.struct(F.lit(6).alias("family"), six.alias("bits")))
    six = _v6_hex(F.lower(F.regexp_replace(F.regexp_replace(ip, r"^\[|\]$", ""), "%.*$", "")))
    return F.when(v4.isNotNull(), F.struct(F.lit(4).alias("family"), _v4_hex(v4).alias("bits"))).otherwise(bind(six, of))


def prefix_key(bits: Column, length: Column) -> Column:
    """The first ``length`` bits of hex digits, as text."""
    whole, rest = F.floor(length / 4).cast("int"), (length % 4).cast("int")
    digit = F.conv(F.substring(bits, whole + 1, F.lit(1)), 16, 10).cast("int")
    return F.concat(F.substring(bits, F.lit(1), whole), F.when(rest > 0, F.concat(
        F.lit("."), F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("string"))).otherwise(F.lit("")))


def network_keys(networks: DataFrame, cidr_col: str = "cidr") -> DataFrame:
    """``cidr, family, length, prefix`` of every well-formed network; bits beyond the length do not count."""
    parts = F.split(F.trim(F.col(cidr_col)), "/")
    rows = networks.select(F.col(cidr_col).alias("cidr"), address_bits(F.get(parts, 0)).alias("a"),
                           F.when(F.size(parts) == 2, F.get(parts, 1)).alias("l"))
    rows = rows.where(F.col("a").isNotNull() & F.col("l").rlike("^[0-9]{1,3}$")).select(
        "cidr", "a.family", "a.bits", F.col("l").cast("int").alias("length"))
    rows = rows.where(F.col("length") <= F.when(F.col("family") == 4, 32).otherwise(128))
    return rows.select("cidr", "family", "length", prefix_key(F.col("bits"), F.col("length")).alias("prefix")).distinct()


def network_hits(addresses: DataFrame, networks: DataFrame, ip_col: str = "ip", cidr_col: str = "cidr") -> DataFrame:
    """``(ip, cidr)`` for every different address and network that holds it. Rows that
    are no address or no network meet nothing."""
    nets = network_keys(networks, cidr_col)
    used = nets.groupBy("family").agg(F.array_sort(F.collect_set("length")).alias("lengths"))  # 2 rows, 162 numbers
    lengths = {r["family"]: r["lengths"] for r in used.collect()}
    seen = addresses.select(F.col(ip_col).alias("ip")).distinct().select("ip", address_bits(F.col("ip")).alias("a"))
    own = F.when(F.col("a.family") == 4, F.array(*[F.lit(x) for x in lengths.get(4, [])]).cast("array<int>")).otherwise(
        F.array(*[F.lit(x) for x in lengths.get(6, [])]).cast("array<int>"))
    keyed = seen.where("a IS NOT NULL").select("ip", "a.family", "a.bits", F.explode(own).alias("length"))
    keyed = keyed.select("ip", "family", "length", prefix_key(F.col("bits"), F.col("length")).alias("prefix"))
    return keyed.join(nets, ["family", "length", "prefix"]).select("ip", "cidr")
