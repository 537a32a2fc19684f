"""Text conventions that the operators share: ASCII lower case and words."""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z only.
LOWER_BYTES = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; pure ASCII texts take the faster built-in ``lower``."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_parts(lowered: bytes, most: int = 1_000_000) -> Iterator[list[bytes]]:
    """All words of a text, in lists that cover about ``most`` bytes each."""
    at = 0
    while at < len(lowered):
        end = len(lowered)
        if end - at > most and (space := _SPACE.search(lowered, at + most)):
            end = space.start()
        yield lowered[at:end].split()
        at = end


def lower_bytes(text: str | None) -> bytes:
    """UTF-8 of ``text`` (null: empty) with A-Z lower-cased; ``bytes.split()`` then gives the words."""
    return (text or "").encode("utf-8", "replace").translate(LOWER_BYTES)
