"""The draws of ``functions.draws`` as SQL expressions."""

from __future__ import annotations

import math
from functools import reduce
from itertools import count

from tidemark.functions.draws import FACTOR, PRIME, SHIFT, known, split_known

_names = count()


class Sql(str):
    """An SQL expression, where a plain text is a tag."""

    __slots__ = ()


def _let(value: str, body) -> str:
    name = f"v{next(_names)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _fold(h: str, part: str) -> str:
    fifth = lambda x: _let(f"{x} * {x} % {PRIME}", lambda y: f"({y} * {y} % {PRIME}) * {x} % {PRIME}")
    return _let(f"(CAST({h} AS BIGINT) * {FACTOR} + {part}) % {PRIME}", lambda x: f"({fifth(x)} + {SHIFT}) % {PRIME}")


def _number(part) -> str:
    if not isinstance(part, Sql):
        return str(known(part))
    return f"(({part} + (({part}) // {PRIME}) % {1 << 20} * 7919) % {PRIME})"


def cell(seed: int, *parts) -> str:
    cut = next((i for i, p in enumerate(parts) if isinstance(p, Sql)), len(parts))
    start, _ = split_known(seed, parts[:cut])
    return reduce(_fold, map(_number, parts[cut:]), str(start))


def uniform(seed: int, *parts) -> str:
    return f"((CAST({cell(seed, *parts)} AS DOUBLE) + 0.5) / {float(PRIME)})"


def normal(seed: int, *parts) -> str:
    return f"(sqrt(-2.0 * ln({uniform(seed, 'r', *parts)})) * cos({2.0 * math.pi} * {uniform(seed, 'a', *parts)}))"


def integer(low: int, high: str | int, seed: int, *parts) -> str:
    return f"CAST(floor({uniform(seed, *parts)} * (({high}) - {low})) + {low} AS BIGINT)"
