"""Splitting of texts into pre-tokens."""

from __future__ import annotations

import numpy as np
import regex

# Letters and numbers that Unicode added after version 16.0, as (first, last).  The tokenizer
# libraries have the tables of 16.0, where these are neither.
NEWER_THAN_16 = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C),
    (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2),
    (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959),
    (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB),
    (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
    (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2),
    (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168),
    (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96),
    (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
    (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F),
    (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)


class Splitter:
    """Finds the pre-tokens of a text by the classes of Unicode 16.0."""

    def __init__(self, pattern: str):
        newer = "".join(rf"\U{first:08x}-\U{last:08x}" for first, last in NEWER_THAN_16)
        strict = pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{newer}])")
        for kind in (r"\p{L}", r"\p{N}"):
            strict = strict.replace(f" ?{kind}+", rf" ?(?:(?![{newer}]){kind})+")
        self._plain, self._strict = regex.compile(pattern), regex.compile(strict)
        self._newer = np.zeros(0x110000, bool)
        for first, last in NEWER_THAN_16:
            self._newer[first : last + 1] = True

    def __call__(self, text: str) -> list[str]:
        if not text.isascii() and self._newer[np.frombuffer(text.encode("utf-32-le"), "<u4")].any():
            return self._strict.findall(text)
        return self._plain.findall(text)
