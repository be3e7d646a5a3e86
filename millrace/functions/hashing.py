"""64-bit hashes as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The long whose XXH64 under Spark's fixed seed 42 is 0: hashed first, it makes the chained hash start from seed 0.
SEED_ZERO = -365884300664092260


def xxh64(text: Column) -> Column:
    """XXH64 with seed 0 of the UTF-8 bytes, as a signed long."""
    return F.xxhash64(F.lit(SEED_ZERO).cast("long"), text)


def unsigned_mod(hash64: Column, n: int) -> Column:
    """hash64 % n with hash64 read as unsigned."""
    return F.pmod(F.pmod(hash64, F.lit(n)) + F.when(hash64 < 0, F.lit(pow(2, 64, n))).otherwise(F.lit(0)), F.lit(n))


def sampled(index: Column, seed: int, rate: float) -> Column:
    """True for a share `rate` of indices: the first eight bytes of sha256("seed:index") as a fraction of 2^64."""
    if rate >= 1:
        return F.lit(True)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), index.cast("string")), 256)
    value = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return value / F.lit(2.0**64) < F.lit(rate)


def mod_mersenne_free(a: Column, x: Column, b: Column, p: int = 4294967311) -> Column:
    """(a * x + b) mod p for a, x, b under 2^32, without leaving signed 64 bits."""
    high = F.shiftright(x, 16)
    return (((a * high) % p) * 65536 + a * x.bitwiseAND(F.lit(65535)) + b) % p
