"""Binary values as Column expressions, and the codecs as Arrow-batched functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lexloom.codecs import cbg, dsc, images, keystream


def uint(c: Column, offset: Column | int, size: int = 4) -> Column:
    """Unsigned little-endian integer of `size` bytes at a byte offset, as a long."""
    part = F.hex(F.substring(c, F.lit(offset) + 1 if isinstance(offset, int) else offset + 1, F.lit(size)))
    swapped = F.concat(*(F.substring(part, 2 * i + 1, 2) for i in reversed(range(size))))
    return F.conv(swapped, 16, 10).cast("long")


def sint(c: Column, offset: Column | int, size: int = 4) -> Column:
    """Signed little-endian integer."""
    v = uint(c, offset, size)
    return F.when(v >= 1 << (8 * size - 1), v - (1 << (8 * size))).otherwise(v)


def pack_int(c: Column) -> Column:
    """A 32-bit integer as four little-endian bytes."""
    h = F.lpad(F.hex(F.when(c < 0, c.cast("long") + (1 << 32)).otherwise(c.cast("long"))), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def bytes_of(c: Column) -> Column:
    """The bytes of a binary value, as an array of ints."""
    h = F.hex(c)
    n = F.octet_length(c)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int"))).otherwise(F.array().cast("array<int>"))


def checksum(c: Column) -> Column:
    """Sum modulo 256 and exclusive or of all bytes."""
    b = bytes_of(c)
    return F.struct(
        F.aggregate(b, F.lit(0), lambda a, x: (a + x) % 256).alias("sum"),
        F.aggregate(b, F.lit(0), lambda a, x: a.bitwiseXOR(x)).alias("xor"),
    )


def high_word(c: Column) -> Column:
    return F.shiftrightunsigned(c, 16)


def low_word(c: Column) -> Column:
    return c.bitwiseAND(0xFFFF)


def high_byte(c: Column) -> Column:
    return F.shiftrightunsigned(c, 8).bitwiseAND(0xFF)


def low_byte(c: Column) -> Column:
    return c.bitwiseAND(0xFF)


def starts_with(c: Column, magic: bytes) -> Column:
    return F.coalesce(F.substring(c, 1, len(magic)) == F.lit(magic), F.lit(False))


def is_compressed(c: Column) -> Column:
    return starts_with(c, dsc.MAGIC)


def kind(c: Column) -> Column:
    """DSC, CBG, PNG, PSD, RAWIMG or RAW: what a binary value holds, by its first bytes."""
    w, h, bpp = sint(c, 0, 2), sint(c, 2, 2), sint(c, 4)
    side = lambda x: (x > 0) & (x < images.SIDE)
    raw = (F.octet_length(c) >= 16) & side(w) & side(h) & (bpp > 0) & (bpp <= 32) & (bpp % 8 == 0) & (sint(c, 8) == 0) & (sint(c, 12) == 0)
    out = F.when(is_compressed(c), "DSC").when(starts_with(c, cbg.MAGIC) & (F.octet_length(c) >= cbg.SMALLEST), "CBG")
    return out.when(starts_with(c, images.PNG), "PNG").when(starts_with(c, images.PSD), "PSD").when(F.coalesce(raw, F.lit(False)), "RAWIMG").otherwise("RAW")


def keystream_values(seed: Column, n: int) -> Column:
    """The first n values of the codec headers' keystream, as an array of longs."""
    mask = lambda x: x.bitwiseAND(0xFFFFFFFF)

    def step(a: Column, _: Column) -> Column:
        v = a["v"]
        low = mask(F.lit(keystream.LOW) * low_word(v))
        high = mask(F.lit(keystream.LOW) * F.shiftrightunsigned(v, 16) + F.lit(keystream.MIDDLE) * v + F.shiftrightunsigned(low, 16))
        after = mask(F.shiftleft(low_word(high), 16) + low_word(low) + 1)
        return F.struct(after.alias("v"), F.concat(a["out"], F.array(high.bitwiseAND(0x7FFF))).alias("out"))

    zero = F.struct(mask(seed.cast("long")).alias("v"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), zero, step, lambda a: a["out"])


def spread(scan: DataFrame) -> DataFrame:
    """Rows of a plain scan dealt to all cores where it has fewer partitions than there are cores:
    codecs cost far more than such a shuffle. A scan of enough partitions stays as it is. (Behind
    a shuffle, counting partitions would run it.)"""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@F.pandas_udf(BinaryType())
def dsc_decompress(data: pd.Series) -> pd.Series:
    """Unpack; what isn't packed stays."""
    return data.map(lambda x: None if x is None else dsc.decompress_if_required(bytes(x)))


def dsc_compress(c: Column, level: int = 9, seed: int = 0) -> Column:
    """Pack, verified by unpacking; a negative level or packed data stays."""

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else bytes(x) if dsc.is_compressed(bytes(x)) else dsc.compress_checked(bytes(x), level, seed))

    return run(c)


#: Code pages by number, as the older tools name them: fixed values.
CODE_PAGES = {"932": "cp932", "1252": "cp1252", "1200": "utf-16-le", "12000": "utf-32-le", "65000": "utf-7", "65001": "utf-8"}


def recode(c: Column, source: str, target: str) -> Column:
    """Bytes from one character set to another, by name or code-page number. Bytes that are not
    of the source set, and characters the target lacks, are errors."""
    a, b = CODE_PAGES.get(source, source), CODE_PAGES.get(target, target)

    @F.pandas_udf(BinaryType())
    def run(data: pd.Series) -> pd.Series:
        return data.map(lambda x: None if x is None else bytes(x).decode(a).encode(b))

    return run(c)
