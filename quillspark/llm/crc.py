"""CRC-32 of many words at once, and of their runs, by algebra on the CRCs alone.

A CRC is a vector over GF(2), and appending n bytes multiplies its register by a matrix that depends on n only. So
``crc(a + b) = shift(crc(a), len(b)) ^ crc(b)``, where ``shift`` is that matrix for len(b) zero bytes: of a run of words
no string is ever built. The matrix for n bytes is the product of those for the powers of two in n; each is kept as four
tables of 256 numbers (one for each byte of the vector).
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

#: CRC-32 in reflected form: x^32 + x^26 + x^23 + x^22 + x^16 + x^12 + x^11 + x^10 + x^8 + x^7 + x^5 + x^4 + x^2 + x + 1.
POLYNOMIAL = 0xEDB88320
#: Words up to this many bytes step together, a byte at a time; longer ones are rare and go one by one.
STEPS = 24
SPACE = zlib.crc32(b" ")


@lru_cache(1)
def byte_table() -> np.ndarray:
    """The register after one byte."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), t >> np.uint32(1))
    return t


@lru_cache(64)
def shift_tables(power: int) -> np.ndarray:
    """The matrix for ``2 ** power`` zero bytes, as four tables of 256: the matrix for half of them, applied twice."""
    columns = np.uint32(1) << np.arange(32, dtype=np.uint32)
    if power == 0:
        columns = (columns >> np.uint32(8)) ^ byte_table()[columns & np.uint32(0xFF)]
    else:
        columns = _apply(shift_tables(power - 1), _apply(shift_tables(power - 1), columns))
    tables = np.zeros((4, 256), dtype=np.uint32)
    for k in range(4):
        for bit in range(8):
            tables[k] ^= np.where((np.arange(256) >> bit) & 1, columns[8 * k + bit], np.uint32(0))
    return tables


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & np.uint32(0xFF)] ^ tables[1][(x >> np.uint32(8)) & np.uint32(0xFF)] ^ tables[2][(x >> np.uint32(16)) & np.uint32(0xFF)] ^ tables[3][x >> np.uint32(24)]


def shifted(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Each CRC after so many zero bytes."""
    x, n = x.copy(), np.asarray(n, dtype=np.int64)
    for power in range(int(n.max(initial=0)).bit_length()):
        hit = np.flatnonzero((n >> power) & 1)
        x[hit] = _apply(shift_tables(power), x[hit])
    return x


def combined(first: np.ndarray, second: np.ndarray, second_length: np.ndarray) -> np.ndarray:
    """CRCs of the concatenations of what two arrays of CRCs stand for."""
    return shifted(first, second_length) ^ second


def words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC of ``data[start:end]`` of each word (bytes)."""
    table, lengths = byte_table(), ends - starts
    register = np.full(len(starts), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(-np.minimum(lengths, STEPS + 1), kind="stable")
    long = int(np.count_nonzero(lengths > STEPS))
    order, rest = order[long:], order[:long]
    at, own, left = starts[order], register[order], lengths[order]
    falling = -left
    for step in range(int(left.max(initial=0))):
        n = int(np.searchsorted(falling, -step, side="left"))  # words of more than ``step`` bytes come first
        own[:n] = (own[:n] >> np.uint32(8)) ^ table[(own[:n] ^ data[at[:n] + step]) & np.uint32(0xFF)]
    register[order] = own
    out = register ^ np.uint32(0xFFFFFFFF)
    for i in rest.tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


def runs(own: np.ndarray, lengths: np.ndarray, owner: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``most`` consecutive words of one owner, joined by a space, and the owner of each.

    A run of k words is a run of k - 1, a space, and one word more.
    """
    found, owners = [own], [owner]
    current = own
    tail = combined(np.full(len(own), SPACE, dtype=np.uint32), own, lengths)  # a space and the word
    for k in range(2, most + 1):
        if len(own) < k:
            break
        current = combined(current[:-1], tail[k - 1 :], lengths[k - 1 :] + 1)
        same = owner[: len(current)] == owner[k - 1 :]
        found.append(current[same])
        owners.append(owner[k - 1 :][same])
    return np.concatenate(found), np.concatenate(owners)
