"""Numbers as text, rounded half away from zero on their 15-digit decimal.

``shown`` writes numbers by a rule that its caller declares: figures kept with their
zeros, thousands grouped, in full up to 15 figures before the point and 6 decimals below
one, else in scientific notation. The rule ``decimals`` takes numbers that are read
together and writes them with the decimals that they need in common."""

from __future__ import annotations

import math
import statistics
from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Context, Decimal


def _decimal(x: float) -> Decimal:
    return Decimal(f"{x:.15g}")


def fixed(x: float, digits: int = 2) -> str:
    return str(_decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def signif(x: float, digits: int = 3) -> str:
    d = _decimal(x)
    if not d:
        return "0"
    d = d.quantize(Decimal(1).scaleb(d.adjusted() - digits + 1), ROUND_HALF_UP)
    return f"{d:f}".rstrip("0").rstrip(".") if "." in f"{d:f}" else f"{d:f}"


def percent(x: float, digits: int = 0) -> str:
    return fixed(100 * _decimal(x).__float__(), digits) + "%"


def p_value(p: float, digits: int = 3) -> str:
    least = 10.0**-digits
    return f"<{fixed(least, digits)}" if p < least else fixed(p, digits)


def ordinal(n: int) -> str:
    end = "th" if n % 100 in (11, 12, 13) else {1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th")
    return f"{n}{end}"


def clock(seconds: float) -> str:
    s = int(_decimal(seconds).quantize(Decimal(1), ROUND_HALF_UP))
    return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}" if s >= 3600 else f"{s // 60}:{s % 60:02d}"


def join_and(words: list[str]) -> str:
    return words[0] if len(words) == 1 else ", ".join(words[:-1]) + " and " + words[-1] if words else ""


#: Figures of a double that are trusted, the power of ten from which numbers are scientific, and the most decimals below one.
FIGURES, FAR, MOST_DECIMALS = 15, 15, 6
RULES = ("signif", "fixed", "percent", "p", "clock", "ordinal", "decimals")
_TO_FIGURES = {n: Context(prec=n, rounding=ROUND_HALF_UP) for n in range(1, FIGURES + 1)}
_WIDE = Context(prec=400, rounding=ROUND_HALF_UP, Emin=-999999, Emax=999999)


def _known(x: float) -> Decimal:
    """The 15 figures by which a number is known, from its exact value."""
    return _TO_FIGURES[FIGURES].plus(Decimal(float(x)))


def _rounded(d: Decimal, digits: int) -> Decimal:
    """To ``digits`` decimals; a number that has no more figures stays as it is."""
    return d if d.as_tuple().exponent >= -digits else d.quantize(Decimal(1).scaleb(-digits), context=_WIDE)


def _figures(d: Decimal, digits: int) -> Decimal:
    """To ``digits`` figures, zeros included."""
    if not d:
        return Decimal(0)
    short = Context(prec=digits, rounding=ROUND_HALF_UP).plus(d)
    return short.quantize(Decimal(1).scaleb(short.adjusted() - digits + 1), context=_WIDE)


def _plain(d: Decimal, digits: int, mark: str, drop: bool = False) -> str:
    """In full with ``digits`` decimals or more figures of its own, thousands grouped."""
    text = f"{abs(d):f}"
    whole, _, part = text.partition(".")
    part = part.ljust(digits, "0")
    part = part.rstrip("0") if drop else part
    sign = "-" if d < 0 and any(c in "123456789" for c in text) else ""
    return sign + f"{int(whole):,}".replace(",", mark) + ("." + part if part else "")


def _scientific(d: Decimal, drop: bool = False) -> str:
    """One figure before the point, and the power of ten with its sign and two digits or more."""
    if not d:
        return "0"
    figures = "".join(map(str, d.as_tuple().digits))
    part = figures[1:].rstrip("0") if drop else figures[1:]
    power = d.adjusted()
    return f"{'-' if d < 0 else ''}{figures[0]}{'.' + part if part else ''}e{'-' if power < 0 else '+'}{abs(power):02d}"


def common_decimals(values: Sequence[float | None], figures: int = 3) -> int:
    """The decimals at which numbers that are read together are written: none if all are
    whole; else enough for ``figures`` figures at their median size, and for the smallest
    to show a figure, at most 6. Numbers that will be scientific set nothing."""
    sizes = [abs(x) for x in values if x is not None and math.isfinite(x) and x and not _apart(x)]
    if not sizes or all(x == math.floor(x) for x in sizes):
        return 0
    need = max(0, figures - 1 - math.floor(math.log10(statistics.median(sizes))), -math.floor(math.log10(min(sizes))))
    return min(need, MOST_DECIMALS)


def _apart(x: float) -> bool:
    """Whether a number needs more than 6 decimals to show a figure, or 16 figures before the point."""
    return bool(x) and (abs(x) >= 10.0**FAR or -math.floor(math.log10(abs(x))) > MOST_DECIMALS)


def _fixed_text(d: Decimal, digits: int, mark: str) -> str:
    short = _rounded(d, digits)
    return _scientific(_figures(d, 7), drop=True) if short and short.adjusted() >= FAR else _plain(short, digits, mark)


def shown(values: Sequence[float | None], rule: str, digits: int | None = None, mark: str = ",", end: bool = False, trailing_zeros: bool = True) -> list[str | None]:
    """The text of each number; missing ones stay missing and infinite ones read Inf.

    ``signif``: ``digits`` figures, zeros at the end kept unless ``trailing_zeros`` is
    false. ``fixed``: ``digits`` decimals. ``percent``: a hundred times that, with a sign.
    ``p``: three figures, below 0.001 only that. ``clock``: an hour of the day, with
    ``end`` its last minute. ``ordinal``: a day of the month. ``decimals``: numbers that
    are read together, at ``digits`` or their common decimals; those that these would
    show as zero, or that are too far off, in scientific notation."""
    if rule not in RULES:
        raise ValueError(f"the rule is one of {', '.join(RULES)}")
    if rule in ("signif", "fixed", "percent") and (digits is None or digits < (rule == "signif")):
        raise ValueError(f"the rule {rule} needs digits")
    if rule == "decimals" and digits is None:
        digits = common_decimals(values)

    def one(x: float | None) -> str | None:
        if x is None or math.isnan(x):
            return None
        if math.isinf(x):
            return "Inf" if x > 0 else "-Inf"
        if rule == "clock":
            return f"{round(x):02d}:{'59' if end else '00'}"
        if rule == "ordinal":
            return ordinal(round(x))
        if rule == "percent":
            return _fixed_text(_known(100 * x), digits, mark) + "%"
        d = _known(x)
        if rule == "fixed":
            return _fixed_text(d, digits, mark)
        if rule == "p":
            short = _figures(d, 3)
            return "< 0.001" if x < 0.001 else _plain(short, 0, "", drop=True)
        if rule == "signif":
            short = _figures(d, digits)
            decimals = max(0, -short.as_tuple().exponent)
            if short and (short.adjusted() >= FAR or (short.adjusted() < 0 and decimals > MOST_DECIMALS)):
                return _scientific(short, drop=not trailing_zeros)
            return _plain(short, decimals, mark, drop=not trailing_zeros)
        text = _plain(_rounded(d, digits), digits, mark)
        lost = x != 0 and not any(c in "123456789" for c in text)
        return _scientific(_figures(d, 3)) if lost or _apart(x) else text

    return [one(x) for x in values]
