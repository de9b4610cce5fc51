"""Terms of texts as Arrow arrays: runs of ASCII letters, digits and characters
above ASCII, with only A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# every byte that no term holds becomes a blank; UTF-8 bytes of other characters are above 0x7F
_TABLE = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def blanked(text: str | None) -> bytes:
    """UTF-8 bytes of ``text`` with blanks between its terms; null is empty."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)


def terms(texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """All terms of ``blanked`` texts in order, and the number of terms in each text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    solid = data != 0x20
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    first, last = edges[::2], edges[1::2]
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(last - first, out=offsets[1:])
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[solid])])
    ends = np.cumsum([len(t) + 1 for t in texts]) if texts else np.zeros(0, np.int64)
    upto = np.searchsorted(first, ends, side="right")
    return words, np.diff(upto, prepend=0)
