"""Column functions: everything here stays in Catalyst expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lit(x) -> Column:
    return F.lit(x)


def octets(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), lit(0)).cast("long")


# --- whole numbers -------------------------------------------------------------------------------------------------


def varint_len(n: Column) -> Column:
    """Bytes of n >= 0 in groups of seven bits."""
    out = lit(9)
    for k in range(8, 0, -1):
        out = F.when(n < (1 << (7 * k)), lit(k)).otherwise(out)
    return out.cast("int")


def varint_hex(n: Column) -> Column:
    """The bytes themselves in hex, low groups first."""
    group = lambda k: F.shiftright(n, 7 * k).bitwiseAND(lit(127))
    more = lambda k: F.when(F.shiftright(n, 7 * (k + 1)) > 0, 128).otherwise(0)
    return F.concat_ws("", *(F.when((F.shiftright(n, 7 * k) > 0) | lit(k == 0), F.lpad(F.hex(group(k) + more(k)), 2, "0")) for k in range(9)))


def padding(n: Column, size: int) -> Column:
    return F.pmod(-n, lit(size))


#: Element sizes and their two-bit codes in the packed byte.
ELEM_CODES = {1: 0, 2: 1, 4: 2, 3: 3}


def pack_descriptor(pad: Column, elem: Column, mode: Column) -> Column:
    """pad in bits 0-1, the element's code in bits 2-3, the mode in bits 5-7.

    Modes over 7 don't fit: they are an error, not another mode.
    """
    code = F.when(elem == 1, 0).when(elem == 2, 1).when(elem == 4, 2).when(elem == 3, 3)
    ok = pad.between(0, 3) & code.isNotNull() & mode.between(0, 7)
    return F.when(ok, pad + code * 4 + mode * 32).otherwise(F.raise_error(lit("pad, element or mode doesn't fit the packed byte"))).cast("int")


def unpack_descriptor(b: Column) -> tuple[Column, Column, Column]:
    code = F.shiftright(b, 2).bitwiseAND(lit(3))
    return b.bitwiseAND(lit(3)), F.when(code == 0, 1).when(code == 1, 2).when(code == 2, 4).otherwise(3), F.shiftright(b, 5)


def zigzag(d: Column) -> Column:
    """0, -1, 1, -2 ... to 0, 1, 2, 3 ..., for 32-bit differences held as long."""
    return F.when(d < 0, -2 * d - 1).otherwise(2 * d)


def wrap32(n: Column) -> Column:
    """Signed 32-bit number of the lowest 32 bits."""
    u = F.pmod(n, lit(1 << 32))
    return F.when(u >= 1 << 31, u - (1 << 32)).otherwise(u)


# --- floats --------------------------------------------------------------------------------------------------------


def float_bits(x: Column) -> Column:
    """The 32 bits of a float as an unsigned number in a long.

    By arithmetic in double precision, exact for all floats: -0.0, subnormal numbers and infinities have branches of their own,
    every NaN is the quiet one without a sign.
    """
    d = x.cast("double")
    a = F.abs(d)
    e = F.floor(F.log2(a))
    normal = (e + 127) * (1 << 23) + ((a / F.pow(lit(2.0), e) - 1) * (1 << 23)).cast("long")
    mag = F.when(a == 0, lit(0).cast("long")).when(F.isnan(d), lit(0x7FC00000).cast("long")).when(a == float("inf"), lit(0x7F800000).cast("long")).when(a < 2.0**-126, (a * 2.0**149).cast("long")).otherwise(normal)
    negative = (d < 0) | (x.cast("string") == "-0.0")
    return F.when(x.isNull(), None).otherwise(mag + F.when(negative, lit(1 << 31)).otherwise(lit(0)))


def plane(u: Column, k: int) -> Column:
    """Byte k (0 the lowest) of an unsigned 32-bit number."""
    return F.shiftright(u, 8 * k).bitwiseAND(lit(255)).cast("int")


def byte_swap(u: Column) -> Column:
    return sum((plane(u, k).cast("long") * (1 << (8 * (3 - k))) for k in range(1, 4)), plane(u, 0).cast("long") * (1 << 24))


#: Lossy levels 1 to 4 and the low bits they clear; a level over 4 is a number of bits, 24 at most.
MASK_BITS = {1: 8, 2: 16, 3: 23, 4: 24}


def mask_bits(level: int) -> int:
    return 0 if level <= 0 else MASK_BITS.get(level, min(level, 24))


def mask_value(x: Column, level: int) -> Column:
    """A normal float with its low bits cleared, as a double: mantissa bits are cut toward zero, 24 bits also clear the lowest exponent bit."""
    bits = mask_bits(level)
    d = x.cast("double")
    a = F.abs(d)
    e = F.floor(F.log2(a))
    if bits >= 24:
        e2 = e - F.pmod(e + 127, lit(2))
        out = F.pow(lit(2.0), e2)
    else:
        step = F.pow(lit(2.0), e - (23 - bits))
        out = F.floor(a / step) * step
    return F.when(d == 0, lit(0.0)).otherwise(F.signum(d) * out)


def ordinal(u: Column) -> Column:
    """Bits to a signed number in the order of the floats; both zeros are 0."""
    return F.when(u >= 1 << 31, -(u - (1 << 31))).otherwise(u)


def from_ordinal(n: Column) -> Column:
    """Bits from `ordinal`; 0 gives the positive zero."""
    return F.when(n < 0, (1 << 31) - n).otherwise(n)


# --- text ----------------------------------------------------------------------------------------------------------


def extension(path: Column) -> Column:
    """Lower-cased suffix of the last part, with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def case_class(word: Column) -> Column:
    """0 lower, 1 upper (one upper letter, too), 2 title, 3 mixed."""
    return F.when(word == F.lower(word), 0).when(word == F.upper(word), 1).when(word == F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30))), 2).otherwise(3).cast("int")


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def parts(text: Column) -> Column:
    """Alternating runs of ASCII letters and of everything else."""
    return F.regexp_extract_all(text, lit("[a-zA-Z]+|[^a-zA-Z]+"), lit(0))


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, lit("[a-zA-Z_][a-zA-Z0-9_]*"), lit(0))


#: Words of several programming languages, our own list for keyword substitution.
KEYWORDS: Sequence[str] = ("return", "function", "import", "class", "while", "static", "const", "struct", "switch", "default", "template", "namespace", "include", "public", "private", "lambda", "yield", "except", "finally", "boolean", "double", "string", "print", "async", "await", "break", "continue", "extends")


def human_size(n: Column) -> Column:
    """Bytes with a binary unit and two decimals."""
    out = F.format_string("%.2f TB", F.round(n / float(1 << 40), 2))
    for unit, power in (("GB", 30), ("MB", 20), ("KB", 10)):
        out = F.when(n < 1 << (power + 10), F.format_string(f"%.2f {unit}", F.round(n / float(1 << power), 2))).otherwise(out)
    return F.when(n < 1024, F.concat(n.cast("string"), lit(" B"))).otherwise(out)


def ratio(original: Column, packed: Column) -> Column:
    return original / F.greatest(packed, lit(1))


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = F.least(F.greatest(p, lit(eps)), lit(1 - eps))
    return F.ln(q / (1 - q))


def squash(z: Column, limit: float = 12.0) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, lit(-limit)), lit(limit))))
