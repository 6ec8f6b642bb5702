"""How registered queries show doubles: sums may differ in their last places between engines."""

from __future__ import annotations

#: Decimal places of values below 1. Larger ones keep the upper 30 of their 53 bits, about nine
#: digits: a decimal place would make ties of prices, which fall either way.
PLACES, SPLIT = 9, 2**23 + 1
#: A power of two that keeps the product with ``SPLIT`` finite.
SCALE = 2**30


def shown(x: str) -> str:
    """SQL of ``x`` to about nine digits, for Spark and for the checking engine. No value is lost:
    large and infinite ones stay, and zero has no sign."""
    part = f"({x}) / {SCALE}e0"
    large = f"{part} * {SPLIT}e0"
    return (
        f"CASE WHEN abs({x}) < 1 THEN round(({x}) * 1e{PLACES}) / 1e{PLACES} + 0e0 "
        f"WHEN abs({x}) <= 1.7976931348623157e308 THEN ({large} - ({large} - {part})) * {SCALE}e0 ELSE CAST({x} AS DOUBLE) END"
    )


def trimmed(x: str) -> str:
    """SQL of ``x`` with the upper 30 bits of its number: what ranks compare, so that values which are equal
    but for the noise of their last places tie in every engine. Relative, so small values keep their order."""
    return f"CASE WHEN abs({x}) < 1e300 THEN ({x}) * {SPLIT}e0 - (({x}) * {SPLIT}e0 - ({x})) ELSE {x} END"
