"""Word hashes in numpy. A word is a run of bytes other than ASCII white space.

A word's identity is a pair of 64-bit hashes under a key. Eight bytes at a time are mixed into each state; a word longer than
`LONG` bytes goes through keyed BLAKE2b, so that a text without white space costs no more steps than others. With a key that
the driver draws for a run, no text can be written to collide; with the fixed `KEY`, results are the same in every run."""

from __future__ import annotations

import secrets
from hashlib import blake2b

import numpy as np

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LONG = 64
KEY = blake2b(b"words", digest_size=32).digest()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def new_key() -> bytes:
    """To be drawn on the driver and sent with a run's tasks; a task that runs again hashes as before."""
    return secrets.token_bytes(32)


_SPACE = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
#: The bytes of a word's last, partial step that belong to it.
_HELD = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def word_spans(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, where words begin, where they end, words of each text), without an object for each word."""
    raw = np.frombuffer(b" ".join([*bodies, bytes(8)]), dtype=np.uint8)
    space = _SPACE[raw[:-8]]
    before = np.concatenate([[True], space[:-1]])
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    stops = np.cumsum(np.fromiter(map(len, bodies), dtype=np.int64, count=len(bodies)) + 1)
    return raw, starts, ends, np.diff(np.searchsorted(starts, np.concatenate([[0], stops])))


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes, lanes: int = 1) -> list[np.ndarray]:
    """`lanes` (1 or 2) 64-bit hashes of each stretch of bytes; raw goes on for 8 bytes after the last."""
    seeds = np.frombuffer(key, "<u8")
    sizes = ends - starts
    eight = np.ndarray((max(len(raw) - 7, 0),), dtype="<u8", buffer=raw, strides=(1,))
    state = [mix(sizes.astype(np.uint64) * _A + seeds[2 * i]) for i in range(lanes)]
    alive, at = np.flatnonzero(sizes <= LONG), 0
    while len(alive):
        part = eight[starts[alive] + at] & _HELD[np.minimum(sizes[alive] - at, 8)]
        for i in range(lanes):
            state[i][alive] = mix((state[i][alive] ^ part) * _A + seeds[2 * i + 1])
        at += 8
        alive = alive[sizes[alive] > at]
    for n in np.flatnonzero(sizes > LONG).tolist():
        whole = blake2b(raw[starts[n] : ends[n]], digest_size=16, key=key).digest()
        for i in range(lanes):
            state[i][n] = int.from_bytes(whole[8 * i : 8 * i + 8], "little")
    return state


def word_stream(bodies: list[bytes], key: bytes, lanes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of all words, one text after another, in each lane; words of each text)."""
    raw, starts, ends, sizes = word_spans(bodies)
    return span_hashes(raw, starts, ends, key, lanes), sizes
