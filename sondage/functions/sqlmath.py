"""Distribution functions as SQL text that Spark and other engines read alike."""

from __future__ import annotations

# The rational approximation of the normal tail published by West (2005), highest power first.
NUMERATOR = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def _horner(coefficients: tuple[float, ...], x: str) -> str:
    text = f"{coefficients[0]!r}e0" if "e" not in repr(coefficients[0]) else repr(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {c!r}e0)"
    return text


def norm_cdf(x: str) -> str:
    """Standard normal distribution function of the SQL expression ``x`` (a double)."""
    a = f"abs({x})"
    tail = f"exp(-{a} * {a} / 2e0)"
    near = f"{tail} * {_horner(NUMERATOR, a)} / {_horner(DENOMINATOR, a)}"
    far = f"{tail} / ({a} + 1e0 / ({a} + 2e0 / ({a} + 3e0 / ({a} + 4e0 / ({a} + 0.65e0))))) / 2.506628274631e0"
    lower = f"(CASE WHEN {a} > 37e0 THEN 0e0 WHEN {a} < 7.07106781186547e0 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0e0 THEN 1e0 - {lower} ELSE {lower} END)"
