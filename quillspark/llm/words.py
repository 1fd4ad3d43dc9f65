"""Texts cut into words a column at a time: byte classes by NumPy, distinct words by Arrow; no Python object for each word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Classes of bytes.  A break also ends a word.
INSIDE, SPACE, BREAK = 0, 1, 2


def classes(space: bytes, broken: bytes = b"") -> np.ndarray:
    """The class of each byte: those in ``space`` part words, those in ``broken`` part pieces, all others are letters of words."""
    found = np.full(256, INSIDE, np.uint8)
    found[list(space)] = SPACE
    found[list(broken)] = BREAK
    return found


class Words:
    """The words of some texts, A-Z in lower case, in order: ``ids`` into ``distinct``, ``text`` (which of the texts) and ``piece`` (words
    with a break between them differ, those of different texts too).  Positions are 32 bits wide: texts of a block have less than 2 GB."""

    def __init__(self, texts: list[bytes | None], table: np.ndarray):
        lowered = [(t or b"").lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in lowered], dtype=np.int32)
        data = np.frombuffer(b"\n".join([*lowered, b""]), np.uint8)
        del lowered
        kind = table[data]
        kind[ends - 1] = BREAK
        inside = kind == INSIDE
        self._breaks = np.flatnonzero(kind == BREAK).astype(np.int32)
        del kind
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False)).astype(np.int32)
        self._starts, offsets = edges[0::2], np.zeros(len(edges) // 2 + 1, np.int32)
        np.cumsum(edges[1::2] - edges[0::2], out=offsets[1:])
        found = pa.StringArray.from_buffers(len(self._starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])).dictionary_encode()
        self.ids, self.distinct = found.indices.to_numpy(zero_copy_only=False), found.dictionary
        self.text = np.searchsorted(ends, self._starts, side="right").astype(np.int32)
        self.lengths = np.bincount(self.text, minlength=len(texts))

    @property
    def piece(self) -> np.ndarray:
        return np.searchsorted(self._breaks, self._starts).astype(np.int32)

    def __len__(self) -> int:
        return len(self.ids)


def column_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 of each text of a column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
