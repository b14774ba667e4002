"""Hashed byte n-gram counts of texts, as dense blocks for matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Documents of a block: a block of counts holds so many rows.
ROWS = 256


def gram_blocks(texts: list[str | None], bits: int, sizes: tuple[int, ...] = (3,)) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts) of blocks of texts: counts[i, h] of the hashed n-grams of the lower-cased text in UTF-8.

    A text stands between two spaces, so that starts and ends of words count alike everywhere; a text without n-grams
    has a row of zeros.
    """
    for first in range(0, len(texts), ROWS):
        data = [b" %b " % (x or "").lower().encode("utf-8", "replace") for x in texts[first : first + ROWS]]
        lengths = np.array([len(x) for x in data])
        flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
        doc = np.repeat(np.arange(len(data), dtype=np.int32), lengths)
        total = np.zeros(len(data) << bits, np.int64)
        for n in sizes:
            if len(flat) < n:
                continue
            m = len(flat) - n + 1
            code = np.full(m, n, np.uint32)
            for k in range(n):
                code = code * np.uint32(0x01000193) + flat[k : k + m]
            code *= np.uint32(0x9E3779B1)
            code >>= np.uint32(32 - bits)
            inside = doc[:m] == doc[n - 1 :]
            total += np.bincount((doc[:m].astype(np.int64) << bits)[inside] + code[inside], minlength=len(total))
        yield first, total.reshape(len(data), 1 << bits)
