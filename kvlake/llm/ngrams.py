"""Hashed byte n-grams of normalised text, in numpy."""

from __future__ import annotations

import re

import numpy as np

_OTHER = re.compile(rb"[^a-z\x80-\xff]+")
_LETTER = re.compile(r"[^\W\d_]")
_STEP = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def plain(text: str | None) -> bytes:
    """Lower case, all but letters as single spaces, a space at either end."""
    return b" " + _OTHER.sub(b" ", (text or "").lower().encode("utf-8")).strip() + b" "


def hashed(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(order - 1, np.uint8)]).astype(np.uint32)
    n, h = len(data), np.full(len(data), order, np.uint32)
    for i in range(order):
        h = (h ^ padded[i : i + n]) * _STEP[i]
        h ^= h >> np.uint32(15)
    return h >> np.uint32(32 - bits)
