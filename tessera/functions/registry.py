"""User functions over columns, with a policy for nulls and failures, and an inverse."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.scalar import with_default


@dataclass(frozen=True)
class UserFunction:
    """A Python function of plain values as an Arrow-batched column function.

    skip_null: a null argument gives null, without a call; otherwise null arguments of primitive types become their
    default. An exception gives null. inverse: the function that gives the first argument from a result.
    """

    function: Callable[..., Any]
    returns: str
    arguments: tuple[str, ...]
    skip_null: bool = True
    inverse: Callable[..., Any] | None = None

    def __call__(self, *columns: Column) -> Column:
        return self._column(self.function, columns)

    def invert(self, *columns: Column) -> Column:
        if self.inverse is None:
            raise ValueError("the function has no inverse")
        return self._column(self.inverse, columns)

    def _column(self, function: Callable[..., Any], columns: tuple[Column, ...]) -> Column:
        skip = self.skip_null
        if not skip:
            columns = tuple(with_default(c, k) for c, k in zip(columns, self.arguments))

        def batch(*series: pd.Series) -> pd.Series:
            out = []
            for row in zip(*series):
                if skip and any(v is None or v != v for v in row):
                    out.append(None)
                    continue
                try:
                    out.append(function(*row))
                except Exception:  # a failed call is a value that isn't set
                    out.append(None)
            return pd.Series(out, dtype="object")

        return F.pandas_udf(batch, self.returns, functionType=F.PandasUDFType.SCALAR)(*columns)


class Functions:
    """Functions, validators and value replacers by name."""

    def __init__(self):
        self.by_name: dict[str, UserFunction] = {}

    def register(self, name: str, returns: str, arguments: tuple[str, ...], **policy: Any) -> Callable:
        def take(function: Callable[..., Any]) -> UserFunction:
            self.by_name[name] = UserFunction(function, returns, arguments, **policy)
            return self.by_name[name]

        return take

    def __getitem__(self, name: str) -> UserFunction:
        return self.by_name[name]
