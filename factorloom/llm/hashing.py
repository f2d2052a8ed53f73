"""Word-shingle hashes of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

# fixed values: the primes of XXH64
P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: longer strings are hashed one by one
LONGEST = 256
#: bytes of texts that are hashed together
TOGETHER = 4 << 20


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def _round(lane: np.ndarray) -> np.ndarray:
    return _turn(lane * P2, 31) * P1


def _equal_lengths(words: np.ndarray, halves: np.ndarray, data: np.ndarray, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    """XXH64 of the strings of one length that start at these places; words and halves are the 8 and 4 bytes from every place on."""
    done = 0
    if length >= 32:
        lanes = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while done + 32 <= length:
            lanes = [_turn(v + words[at + (done + 8 * i)] * P2, 31) * P1 for i, v in enumerate(lanes)]
            done += 32
        out = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
        for v in lanes:
            out = (out ^ _round(v)) * P1 + P4
    else:
        out = np.full(len(at), seed + P5, np.uint64)
    out = out + np.uint64(length)
    while done + 8 <= length:
        out = _turn(out ^ _round(words[at + done]), 27) * P1 + P4
        done += 8
    if done + 4 <= length:
        out = _turn(out ^ halves[at + done] * P1, 23) * P2 + P3
        done += 4
    while done < length:
        out = _turn(out ^ data[at + done] * P5, 11) * P1
        done += 1
    out = (out ^ out >> np.uint64(33)) * P2
    out = (out ^ out >> np.uint64(29)) * P3
    return out ^ out >> np.uint64(32)


def xxh64_spans(data: bytes, starts: np.ndarray, lengths: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of many strings inside ``data``, those of one length at a time."""
    import xxhash

    padded = data + bytes(8)
    view = lambda kind: np.ndarray((len(data) + 1,), kind, padded, strides=(1,))
    words, halves, single = view("<u8"), view("<u4"), np.frombuffer(padded, np.uint8)
    out = np.zeros(len(starts), np.uint64)
    order = np.argsort(lengths, kind="stable")
    sizes, first = np.unique(lengths[order], return_index=True)
    with np.errstate(over="ignore"):
        for length, members in zip(sizes.tolist(), np.split(order, first[1:])):
            if length <= LONGEST:
                out[members] = _equal_lengths(words, halves, single, starts[members], length, np.uint64(seed))
            else:
                out[members] = [xxhash.xxh64_intdigest(data[a : a + length], seed) for a in starts[members].tolist()]
    return out


def _together(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def shingle_hashes(texts: list[str | None], *shingles: int, seed: int = 42) -> Iterator[tuple[np.ndarray, ...]]:
    """For each text, and each of the numbers of words, the XXH64 of every shingle in order; of the whole sequence if that is shorter; none without words."""
    for part in _together(texts):
        data = b"\n".join(b" ".join(t.encode().lower().split()) for t in part)  # bytes: A-Z and ASCII white space only
        raw = np.frombuffer(data, np.uint8)
        ends = np.append(np.flatnonzero((raw == 32) | (raw == 10)), len(raw))
        starts = np.concatenate(([0], ends[:-1] + 1))
        text = np.concatenate(([0], np.cumsum(raw[ends[:-1]] == 10)))
        real = ends > starts
        starts, ends, text = starts[real], ends[real], text[real]
        counts = np.bincount(text, minlength=len(part))
        cuts = np.cumsum(counts)[:-1]
        last = np.repeat(np.cumsum(counts), counts) - 1  # the last word of each word's text
        whole = []
        for n in shingles:
            until = np.minimum(np.arange(len(starts)) + n - 1, last)
            hashes = xxh64_spans(data, starts, ends[until] - starts, seed)
            whole.append([h[: max(1, len(h) - n + 1)] for h in np.split(hashes, cuts)])
        yield from zip(*whole)


def majority_bits(hashes: list[np.ndarray]) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes; 0 for none. Four counters share a word, emptied before they overflow."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    every, most = np.concatenate(hashes), 65_535
    pieces = -(-sizes[some] // most)
    first = np.concatenate(([0], np.cumsum(pieces)[:-1]))  # the first piece of each text
    begin = np.concatenate(([0], np.cumsum(sizes[some])[:-1]))
    at = np.repeat(begin, pieces) + most * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    for bit in range(16):
        packed = np.add.reduceat(every >> np.uint64(bit) & np.uint64(0x0001000100010001), at)
        counts = np.add.reduceat(packed.astype("<u8").view("<u2").reshape(-1, 4).astype(np.int64), first, axis=0)
        for lane in range(4):
            out[some] |= (2 * counts[:, lane] > sizes[some]).astype(np.uint64) << np.uint64(16 * lane + bit)
    return out
