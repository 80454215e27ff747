"""Canonical text of a JSON value: equal values give equal text, whatever their spelling."""

from __future__ import annotations

import json
from decimal import Decimal


def _number(x: str) -> Decimal:
    return Decimal(x)


def _no_constant(x: str):
    raise ValueError(x)


def _text(v) -> str:
    if isinstance(v, Decimal):
        return "0" if v == 0 else f"{v.normalize():E}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_text(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_text, v)) + "]"
    return json.dumps(v)


def canonical(text: str | None) -> str | None:
    """The canonical text of `text`; None for None.

    Key order, white space, escapes and the spelling of a number do not matter; of a repeated key the last value counts.
    Text that is not JSON is compared as it stands, marked so that it equals no JSON value.
    """
    if text is None:
        return None
    try:
        return _text(json.loads(text, parse_int=_number, parse_float=_number, parse_constant=_no_constant))
    except (ValueError, RecursionError, ArithmeticError):
        return "\x00" + text
