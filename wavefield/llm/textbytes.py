"""Vectorised helpers over the UTF-8 bytes of many texts: blocks of texts, lines, words, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are looked at together, about.
BLOCK = 4 << 20
#: The white space of the word definition: blank and the six controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def blocks(texts: list[str | None], limit: int = BLOCK, most: int = 1 << 30) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first, encoded texts) in runs of about limit bytes and at most so many texts; a null
    text is empty."""
    first, run, size = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        if run and (size + len(data) > limit or len(run) >= most):
            yield first, run
            first, run, size = i, [], 0
        run.append(data)
        size += len(data) + 1
    if run:
        yield first, run


def joined(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes with a line feed after each, and where each text starts (one more at the end)."""
    sizes = np.fromiter(map(len, run), np.int64, len(run)) + 1
    return np.frombuffer(b"\n".join(run) + b"\n", np.uint8), np.concatenate([[0], np.cumsum(sizes)])


def mixed(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of a word that are hashed place by place, and the odd numbers that bytes are multiplied with.
PLACES = 16
_POWERS = mixed(np.arange(4096, dtype=np.uint64) + np.uint64(1)) | np.uint64(1)


def words(buf: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the runs of bytes that are not space."""
    edge = np.flatnonzero(np.concatenate([[not space[:1].all()], space[1:] != space[:-1], [not space[-1:].all()]]))
    starts, ends = np.ascontiguousarray(edge[::2]), np.ascontiguousarray(edge[1::2])
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    # sum of byte * odd power of its place in the word, over the word: place by place, the tails of longer words at once
    sizes = ends - starts
    order = np.argsort(np.minimum(sizes, PLACES + 1).astype(np.uint8), kind="stable")
    shorter = np.cumsum(np.bincount(np.minimum(sizes, PLACES + 1), minlength=PLACES + 2))  # words of at most j bytes
    first, value = starts[order], np.zeros(len(starts), np.uint64)
    for j in range(PLACES):
        k = shorter[j]
        value[k:] += _POWERS[j] * (buf[first[k:] + j].astype(np.uint64) + np.uint64(1))
    long = order[shorter[PLACES] :]
    if len(long):
        tail = sizes[long] - PLACES
        begin = np.cumsum(tail) - tail
        place = PLACES + np.arange(tail.sum()) - np.repeat(begin, tail)
        power = _POWERS.take(place, mode="clip")
        far = place >= len(_POWERS)
        if far.any():
            power[far] = mixed(place[far].astype(np.uint64)) | np.uint64(1)
        power *= buf[np.repeat(starts[long], tail) + place].astype(np.uint64) + np.uint64(1)
        value[shorter[PLACES] :] += np.add.reduceat(power, begin)
    sums = np.empty(len(starts), np.uint64)
    sums[order] = value
    return starts, ends, mixed(sums + sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
