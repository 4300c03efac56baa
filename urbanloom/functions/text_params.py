"""Parsers of the parameter mini-languages (`key=value, ...`); commas and semicolons separate entries."""

from __future__ import annotations


def entries(text: str | None) -> list[str]:
    return [t.strip() for t in str(text or "").replace(";", ",").split(",") if t.strip()]


def parse_standards(text: str) -> list[tuple[str, float]]:
    """keyword=area per head, in order; a category has the first keyword that its name contains."""
    out = []
    for entry in entries(text):
        key, sep, value = (p.strip() for p in entry.partition("="))
        if not sep:
            raise ValueError(f"a standard is keyword=value: {entry!r}")
        number = _number(value, entry)
        if not key or number < 0:
            raise ValueError(f"not a valid standard: {entry!r}")
        out.append((key.lower(), number))
    if not out:
        raise ValueError("no standards are given")
    return out


def parse_rules(text: str | None, defaults: dict[str, float]) -> dict[str, float]:
    """defaults with the given key=value entries; unknown keys are errors."""
    rules = dict(defaults)
    for entry in entries(text):
        key, sep, value = (p.strip() for p in entry.partition("="))
        if not sep or key.lower() not in rules:
            raise ValueError(f"not a known rule: {entry!r}")
        rules[key.lower()] = _number(value, entry)
    return rules


def parse_weights(text: str | None, known: set[str]) -> tuple[dict[str, float], list[str]]:
    """Positive weights by key, and the keys that are not known (kept, once each)."""
    weights, unknown = {}, []
    for entry in entries(text):
        key, sep, value = (p.strip() for p in entry.partition("="))
        if not sep or not key:
            raise ValueError(f"a weight is key=number: {entry!r}")
        number = _number(value, entry)
        if number <= 0:
            raise ValueError(f"a weight must be positive: {entry!r}")
        weights[key] = number
        if key not in known and key not in unknown:
            unknown.append(key)
    return weights, unknown


def parse_hierarchy(text: str) -> list[tuple[float, float]]:
    """min_ha=max_dist classes, ascending by size."""
    out = []
    for entry in entries(text):
        size, sep, distance = (p.strip() for p in entry.partition("="))
        if not sep:
            raise ValueError(f"a class is min_ha=max_dist: {entry!r}")
        pair = (_number(size, entry), _number(distance, entry))
        if pair[0] < 0 or pair[1] <= 0:
            raise ValueError(f"not a valid class: {entry!r}")
        out.append(pair)
    if not out:
        raise ValueError("no classes are given")
    return sorted(out)


def parse_breaks(text: str) -> list[float]:
    """Positive numbers, ascending, each once."""
    found = sorted({_number(e, e) for e in entries(text)})
    if not found or found[0] <= 0:
        raise ValueError("breaks must be positive numbers")
    return found


def _number(text: str, entry: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"not a number in {entry!r}") from None


#: Words for no limit.
UNLIMITED = {"n", "rn", "global", "inf"}


def parse_radii(text: str) -> list[float | None]:
    """Radii above 0; words for no limit, and an empty text, stand for None."""
    found = [None if e.lower() in UNLIMITED else _number(e, e) for e in entries(text)]
    if any(r is not None and not r > 0 for r in found):
        raise ValueError(f"a radius must be above 0: {text!r}")
    return found or [None]


def parse_targets(text: str) -> dict[str, float]:
    """Areas by use from 'use=area, use=area'; names are free, areas not below 0, the last of equal names holds."""
    out: dict[str, float] = {}
    for part in filter(None, (p.strip() for p in text.replace(";", ",").split(","))):
        name, equals, value = part.partition("=")
        try:
            area = float(value)
        except ValueError:
            area = -1.0
        if not name.strip() or not equals or not area >= 0:
            raise ValueError(f"not a use and its area: {part!r}")
        out[name.strip()] = area
    if not out:
        raise ValueError("no targets")
    return out


def parse_compat(text: str) -> dict[tuple[str, str], float]:
    """How well uses go together, from 'a|b=value, a|a=value'."""
    out: dict[tuple[str, str], float] = {}
    for part in filter(None, (p.strip() for p in text.replace(";", ",").split(","))):
        pair, equals, value = part.partition("=")
        a, bar, b = (x.strip() for x in pair.partition("|"))
        try:
            number = float(value)
        except ValueError:
            equals = ""
        if not (a and b and bar and equals):
            raise ValueError(f"not a pair of uses and a value: {part!r}")
        out[a, b] = number
    return out
