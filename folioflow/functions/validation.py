"""Checks of the arguments of the engine's operations; each returns the value to use."""

from __future__ import annotations

from typing import Any

from folioflow.functions.errors import ValidationError

# Limits and requirement levels.
QUERY_MAX, TERM_MAX, SPEC_MAX = 500, 200, 50
DEPTHS, RESULTS, DEFAULT_RESULTS = (1, 10), (1, 50), 10
LEVELS = ("shall", "shall not", "should", "should not", "may")


def _text(name: str, value: Any, most: int | None = None) -> str:
    if not isinstance(value, str):
        raise ValidationError(f"{name} must be a string, got {type(value).__name__}")
    if not value.strip():
        raise ValidationError(f"{name} must not be empty")
    if most is not None and len(value) > most:
        raise ValidationError(f"{name} too long (max {most} characters)")
    return value


def _whole(name: str, value: Any, least: int, most: int) -> int:
    whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if not whole or not least <= value <= most:
        raise ValidationError(f"{name} must be an integer between {least} and {most}, got {value}")
    return int(value)


def section(value: Any) -> str:
    return _text("Section", value)


def optional_section(value: Any) -> str | None:
    return None if value is None else section(value)


def query(value: Any) -> str:
    return _text("Query", value, QUERY_MAX)


def term(value: Any) -> str | None:
    return None if value is None else _text("term", value, TERM_MAX).strip()


def max_depth(value: Any) -> int | None:
    return None if value is None else _whole("max_depth", value, *DEPTHS)


def max_results(value: Any) -> int:
    return DEFAULT_RESULTS if value is None else _whole("max_results", value, *RESULTS)


def level(value: Any) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str):
        raise ValidationError(f"level must be a string, got {type(value).__name__}")
    if (found := value.lower().strip()) not in LEVELS:
        raise ValidationError(f'Invalid requirement level "{value}". Valid levels: {", ".join(LEVELS)}')
    return found


def table_index(value: Any) -> int | None:
    if value is None:
        return None
    if not isinstance(value, int) or isinstance(value, bool) or value < 0:
        raise ValidationError(f"table_index must be a non-negative integer, got {value}")
    return value


def spec(value: Any) -> str | None:
    if value is None:
        return None
    if not isinstance(value, str) or not value:
        raise ValidationError("spec must be a non-empty string")
    if len(value) > SPEC_MAX:
        raise ValidationError(f"spec must be {SPEC_MAX} characters or less")
    return value
