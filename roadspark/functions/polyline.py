"""Encoded polylines (precision 5 or 6)."""

from __future__ import annotations

import math


def encode(coords: list[tuple[float, float]], precision: int = 5) -> str:
    out, last, scale = [], (0, 0), 10**precision
    for point in coords:
        now = tuple(int(math.copysign(math.floor(abs(x) * scale + 0.5), x)) for x in point)
        for a, b in zip(now, last):
            value = (a - b) << 1
            value = ~value if value < 0 else value
            while value >= 32:
                out.append(chr((value & 31 | 32) + 63))
                value >>= 5
            out.append(chr(value + 63))
        last = now
    return "".join(out)


def decode(text: str, precision: int = 5) -> list[tuple[float, float]]:
    values, shift, value = [], 0, 0
    for c in text:
        bits = ord(c) - 63
        value |= (bits & 31) << shift
        shift += 5
        if bits < 32:
            values.append(~(value >> 1) if value & 1 else value >> 1)
            shift = value = 0
    out, at = [], [0, 0]
    for a, b in zip(values[::2], values[1::2]):
        at = [at[0] + a, at[1] + b]
        out.append((at[0] / 10**precision, at[1] / 10**precision))
    return out
