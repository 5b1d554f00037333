"""Byte tokens of a sequence-to-sequence model, inside the engine: ids from texts, and texts from ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ids of the padding and end tokens, what stands for a position without loss, and the id of byte 0.
PAD, END, NO_LOSS, FIRST_BYTE = 0, 1, -100, 3


def byte_ids(text: str | Column, max_length: int = 512) -> Column:
    """Ids of the UTF-8 bytes and the end token, at most ``max_length`` with it; null text stays null."""
    t = F.col(text) if isinstance(text, str) else text
    n = F.least(F.octet_length(t), F.lit(max_length - 1))
    code = F.hex(F.substring(F.encode(t, "UTF-8"), F.lit(1), F.lit(max_length - 1)))
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: F.conv(F.substring(code, 2 * k - 1, F.lit(2)), 16, 10).cast("int") + FIRST_BYTE)).otherwise(F.array().cast("array<int>"))
    return F.when(t.isNotNull(), F.concat(ids, F.array(F.lit(END))))


def labels(ids: str | Column) -> Column:
    """Ids as labels: padding counts for no loss."""
    return F.transform(ids, lambda x: F.when(x == PAD, NO_LOSS).otherwise(x))


def text_of_ids(ids: str | Column) -> Column:
    """Text of ids or labels without padding, end and positions without loss; bytes that are no UTF-8 are dropped."""
    kept = F.filter(ids, lambda x: (x >= FIRST_BYTE) & (x < FIRST_BYTE + 256))
    code = F.array_join(F.transform(kept, lambda x: F.lpad(F.hex(x - FIRST_BYTE), 2, "0")), "")
    # Broken bytes become the replacement character, which texts of the editions don't hold.
    return F.replace(F.make_valid_utf8(F.unhex(code).cast("string")), F.lit("�"), F.lit(""))
