"""Register arithmetic and notation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import lookup

# Fixed values.
ACCESS_NAMES = {"read-only": "RO", "write-only": "WO", "read-write": "RW", "writeOnce": "W1", "read-writeOnce": "RW1"}
PRIORITY = "SPI USART UART TIM GPIO RCC DMA ADC I2C CAN DAC IWDG WWDG PWR EXTI SYSCFG FLASH".split()
CATEGORY_POINTS = {"base_address": 0, "access_type": 1, "register_offset": 1, "reset_value": 2, "bit_field": 2}
DASH = "—"


def parse_int(c: Column) -> Column:
    """Decimal, 0x or # binary notation; null if it is none. The 64 bits of larger numbers are kept."""
    t = F.lower(F.trim(c))
    hexa = F.conv(F.nullif(F.regexp_extract(t, r"^0x([0-9a-f]{1,16})\z", 1), F.lit("")), 16, -10).cast("long")
    binary = F.conv(F.nullif(F.regexp_extract(t, r"^(?:#|0b)([01]+)\z", 1), F.lit("")), 2, -10).cast("long")
    return F.coalesce(hexa, binary, t.try_cast("long"))


def hex_format(v: Column, width: int | Column) -> Column:
    """at least ``width`` digits; a dash for null."""
    w = F.lit(width) if isinstance(width, int) else width
    d = F.hex(v)
    return F.coalesce(F.concat(F.lit("0x"), F.repeat(F.lit("0"), F.greatest(w - F.length(d), F.lit(0))), d), F.lit(DASH))


def bit_range(offset: Column, width: Column) -> Column:
    """F13."""
    msb = (offset + width - 1).cast("string")
    return F.when(width == 1, F.concat(F.lit("["), msb, F.lit("]"))).otherwise(F.concat(F.lit("["), msb, F.lit(":"), offset.cast("string"), F.lit("]")))


def field_value(reset: Column, offset: Column, width: Column) -> Column:
    """Bits of a reset value; null where offset or width make no sense."""
    ok = (width > 0) & (offset >= 0) & (offset < 64)
    at = F.call_function("shiftrightunsigned", reset.cast("long"), F.when(ok, offset).otherwise(0).cast("int"))
    mask = F.when(width >= 64, F.lit(-1).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.when(ok, F.least(width, F.lit(63))).otherwise(0).cast("int")) - 1)
    return F.when(ok, at.bitwiseAND(mask))


def field_reset(reset: Column, offset: Column, width: Column) -> Column:
    """F11."""
    v = field_value(reset, offset, width)
    digits = F.greatest(F.ceil(width / 4.0), F.lit(1)).cast("int")
    return F.when(reset.isNull(), DASH).otherwise(F.coalesce(F.when(v.isNotNull(), hex_format(v, digits)), F.lit("0x0")))


def access_code(c: Column) -> Column:
    """F14."""
    return F.coalesce(lookup(c, ACCESS_NAMES), c, F.lit(DASH))


def priority(name: Column) -> Column:
    """Place of the first prefix in the list of priorities, or their number."""
    out = F.lit(len(PRIORITY))
    for n, prefix in reversed(list(enumerate(PRIORITY))):
        out = F.when(F.upper(name).startswith(prefix), n).otherwise(out)
    return out


def difficulty(category: Column, peripheral: Column, single_bit: Column, nonzero_reset: Column) -> Column:
    """F57."""
    rank = priority(peripheral)
    points = F.when(rank >= 10, 2).when(rank >= 5, 1).otherwise(0) + F.coalesce(lookup(category, CATEGORY_POINTS), F.lit(1)) + single_bit.cast("int") + nonzero_reset.cast("int")
    return F.when(points <= 1, "easy").when(points <= 3, "medium").otherwise("hard")
