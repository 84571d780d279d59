"""Text rules that Spark has no expression for, as Arrow functions."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TAGS = re.compile(r"<[^>]*>")


@F.pandas_udf(T.ArrayType(T.StringType()))
def visible_lines(text: pd.Series) -> pd.Series:
    """Visible lines of a marked-up cue: references decoded, tags dropped, compatibility forms folded, white space squeezed."""

    def lines(t: str | None) -> list[str]:
        plain = unicodedata.normalize("NFKC", _TAGS.sub("", html.unescape(t or "")))
        return [x for x in (" ".join(line.split()) for line in plain.splitlines()) if x]

    return text.map(lines)


def line_detector(detect: Callable[[pd.Series], pd.Series]) -> Callable[[Column], Column]:
    """A language detector given by the caller, as a column function over lines."""
    return F.pandas_udf(detect, "string")


#: Factories of caller-supplied column functions, by kind and name.
_BACKENDS: dict[tuple[str, str], Callable[..., Callable[[Column], Column]]] = {}


def register_backend(kind: str, name: str, factory: Callable[..., Callable[[Column], Column]]) -> None:
    _BACKENDS[kind, name] = factory


def backend(kind: str, name: str, /, **options: object) -> Callable[[Column], Column]:
    """The column function of a registered backend; an unknown name fails with the known ones."""
    if (kind, name) not in _BACKENDS:
        raise KeyError(f"no {kind} backend {name!r}; known: {sorted(n for k, n in _BACKENDS if k == kind)}")
    return _BACKENDS[kind, name](**options)
