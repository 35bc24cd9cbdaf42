"""What functions there are: arity and signature text, from the modules that implement them."""

from __future__ import annotations

#: Table functions and their default column names.
TABLE_FUNCTIONS: dict[str, tuple] = {"UNNEST": ("unnest",), "EXPLODE": ("explode",), "JSON_EACH": ("key", "value")}
WINDOW_FUNCTIONS: dict[str, tuple] = {"ROW_NUMBER": (0, 0, ""), "LAG": (1, 3, "value[, offset[, default]]"), "LEAD": (1, 3, "value[, offset[, default]]")}


def _tables() -> tuple[dict, dict]:
    from veinstone.functions import aggregates, scalars

    return scalars.REGISTRY, aggregates.REGISTRY


class _Aggregates:
    """Aggregate names, looked up late so that modules may import each other."""

    def __contains__(self, name: str) -> bool:
        return name in _tables()[1]

    def __iter__(self):
        return iter(_tables()[1])


AGGREGATES = _Aggregates()


def names() -> list[str]:
    scalar, aggregate = _tables()
    return [*scalar, *aggregate, *WINDOW_FUNCTIONS, *TABLE_FUNCTIONS]


def signature(name: str, functions: dict | None = None) -> tuple | None:
    """(least, most, text) of a function; built-in ones win over user functions. None if unknown."""
    scalar, aggregate = _tables()
    for table in (scalar, aggregate):
        if name in table:
            return table[name].low, table[name].high, table[name].text
    if name in WINDOW_FUNCTIONS:
        return WINDOW_FUNCTIONS[name]
    if name in TABLE_FUNCTIONS:
        return 1, 1, "value" if name == "JSON_EACH" else "array"
    if functions and name in functions:
        f = functions[name]
        return f.low, f.high, f.text
    return None
