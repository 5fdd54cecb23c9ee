"""Picking known keys out of a string map."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def present_key(m: Column, keys: Sequence[str]) -> Column:
    """The first of `keys` that the map has, even with a NULL value."""
    wanted = F.array(*[F.lit(k) for k in keys])
    return F.get(F.array_intersect(wanted, F.map_keys(m)), F.lit(0))


def first_present(m: Column, keys: Sequence[str]) -> Column:
    """Value of the first key that the map has."""
    return F.try_element_at(m, present_key(m, keys))


def residual_fields(m: Column, *used: Column) -> Column:
    """The map without the keys that the `used` columns name."""

    def unused(k: Column, _: Column) -> Column:
        kept = ~k.eqNullSafe(used[0])
        for name in used[1:]:
            kept = kept & ~k.eqNullSafe(name)
        return kept

    return F.map_filter(m, unused)


def without_keys(m: Column, keys: Sequence[str]) -> Column:
    """The map without fixed keys."""
    return F.map_filter(m, lambda k, _: ~k.isin(*keys))


def guard_name() -> str:
    """A member name that no input can hold but by chance."""
    return f"g{uuid.uuid4().hex}"


def json_map(text: Column) -> Column:
    """A JSON object as map<string,string>, NULL if it is none; nested values stay JSON text.

    The object must be the whole text. It is parsed as the first of a list of two, since a parser stops at the end of a
    value: any text that follows the object breaks the list or hides its second value, whose name is chosen anew each time.
    """
    strict = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
    guard = guard_name()
    both = F.from_json(F.concat(F.lit("["), text, F.lit(f',{{"{guard}":"1"}}]')), "array<map<string,string>>", strict)
    whole = (F.size(both) == 2) & F.coalesce(F.try_element_at(F.get(both, F.lit(1)), F.lit(guard)) == "1", F.lit(False))
    return F.when(F.startswith(text, F.lit("{")) & whole, F.get(both, F.lit(0)))
