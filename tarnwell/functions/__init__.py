"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def token_of(raw: Column) -> Column:
    """FUN-01: the first eight bytes of SHA-256, unsigned."""
    return F.conv(F.substring(F.sha2(raw, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def be32(n: Column) -> Column:
    """Four bytes, most significant first."""
    return F.unhex(F.lpad(F.hex(n), 8, "0"))


def be64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def label(name: str) -> Column:
    """A domain's label and a zero byte."""
    return F.lit(name.encode() + b"\0").cast("binary")


# The labels of the three kinds of tokens.
SHARD, NODE, ANCHOR = "DKVSHARD", "DKVNODE", "DKVANCHOR"


def shard_token(shard: Column, vnode: Column) -> Column:
    """FUN-02: a shard's position on the ring."""
    return token_of(F.concat(label(SHARD), be32(shard), be32(vnode)))


def node_token(node: Column, vnode: Column) -> Column:
    return token_of(F.concat(label(NODE), node.cast("binary"), be32(vnode)))


def anchor_token(shard: Column) -> Column:
    """Where on the node ring a shard's replicas begin."""
    return token_of(F.concat(label(ANCHOR), be32(shard)))


def backoff(attempt: Column, base: int, cap: int) -> Column:
    """FUN-06: base * 2^attempt, capped."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(float(cap))).cast("long")


def key_name(index: Column, prefix: str = "key:", width: int = 8) -> Column:
    """FUN-07: prefix and zero-padded index."""
    return F.format_string(f"{prefix}%0{width}d", index)


def value_pattern(index: Column, size: int) -> Column:
    """FUN-08: eight bytes of index, then its last byte repeated."""
    tail = F.unhex(F.repeat(F.lpad(F.hex(F.pmod(index, F.lit(256))), 2, "0"), max(0, size - 8)))
    return F.concat(be64(index), tail)


def value_index(value: Column) -> Column:
    return F.conv(F.hex(F.substring(value, 1, 8)), 16, 10).cast("long")


def mix_pick(u: Column, read: float, delete: float) -> Column:
    """FUN-09: an operation by where a uniform number falls."""
    return F.when(u < read, "get").when(u < read + delete, "delete").otherwise("put")


def varint_length(n: Column) -> Column:
    """FUN-13, PRJ-02: bytes of a number in base 128; zero takes one."""
    return F.greatest(F.ceil(F.length(F.bin(n)) / 7), F.lit(1)).cast("int")


def escape_label(s: Column) -> Column:
    """FUN-11: a label value as exposition text holds it."""
    return F.replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit('"'), F.lit('\\"'))


def ratio(a: Column, b: Column) -> Column:
    """FUN-12: a / b, null where b is 0."""
    return F.try_divide(a, b)


def fingerprint(op: Column, key: Column, value: Column) -> Column:
    """FUN-03: a digest of what a command does, whoever sends it: each part with its length."""
    k, v = key.cast("binary"), F.coalesce(value.cast("binary"), F.lit(b"").cast("binary"))
    return F.sha2(F.concat(op.cast("binary"), be32(F.octet_length(k)), k, be32(F.octet_length(v)), v), 256)
