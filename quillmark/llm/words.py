"""Words of letters and digits, on the UTF-8 bytes of a text.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became a-z: ASCII digits and letters, and everything
beyond ASCII. All bytes of a character beyond ASCII are 128 or more, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at once.
PIECE = 4 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def pieces(text: bytes, size: int = PIECE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists whose size is bounded (but for a word that is longer than a piece)."""
    plain = text.translate(_TABLE)
    at = 0
    while at < len(plain):
        end = len(plain) if at + size >= len(plain) else plain.find(b" ", at + size)
        end = len(plain) if end < 0 else end
        yield plain[at:end].split()
        at = end


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null: empty."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""
