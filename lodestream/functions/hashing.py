"""Hash families over whole strings, in JVM expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class HashFamily:
    """Functions x -> ((a x + b) mod p) mod size, by the triples (a, b, p)."""

    params: tuple[tuple[int, int, int], ...]
    size: int


def next_prime(n: int) -> int:
    """The smallest prime from ``n`` on."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def hash_family(count: int, size: int = 69_997, seed: int = 1, bits: int = 20) -> HashFamily:
    """``count`` functions from a seed; a, b and p are below 2**bits (p the next prime), and p at least
    2**(bits - 1), so that products stay within 64 bits."""
    state, out = seed, []

    def draw(low: int, high: int) -> int:
        nonlocal state
        state = (state * 6_364_136_223_846_793_005 + 1_442_695_040_888_963_407) % 2**64
        return low + (state >> 33) % (high - low)

    for _ in range(count):
        out.append((draw(1, 2**bits), draw(1, 2**bits), next_prime(draw(2 ** (bits - 1), 2**bits))))
    return HashFamily(tuple(out), size)


def bytes_mod(text: Column, p: Column) -> Column:
    """The UTF-8 bytes of a string as one big-endian integer, modulo p (below 2**55): by Horner's
    rule over the bytes, as the integer itself fits no type. 0 for the empty string, null for null."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    at = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), (F.length(hexed) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substr(hexed, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
    return F.when(text.isNotNull(), F.aggregate(at, F.lit(0).cast("long"), lambda acc, i: (acc * 256 + byte(i)) % p))


def hashed(text: Column, family: HashFamily) -> Column:
    """An array of a string's value under each function of the family."""
    params = F.array(*[F.struct(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(p).cast("long").alias("p")) for a, b, p in family.params])
    return F.transform(params, lambda f: ((f["a"] * bytes_mod(text, f["p"]) + f["b"]) % f["p"]) % family.size)


def trailing_zeros(x: Column) -> Column:
    """Zeros at the end of a number's binary form; 1 for 0, whose form is a single zero."""
    form = F.bin(x)
    return F.length(form) - F.length(F.rtrim(form, F.lit("0")))


def uniform_of(x: Column, multiplier: int, increment: int) -> Column:
    """A fixed draw in [0, 1) for an integer, by one step of a congruential generator mod 2**31."""
    return ((x % 1_000_003) * multiplier + increment) % 2_147_483_648 / F.lit(2_147_483_648.0)
