"""String similarity in percent by the longest common subsequence (C22), in Arrow batches."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F


def ratio(a: str, b: str) -> float:
    """200 times the longest common subsequence over both lengths; 100 for two empty texts. One machine word operation a letter."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        hit = state & masks.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return 200.0 * (len(a) - state.bit_count()) / (len(a) + len(b))


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best ratio among the common words and the common words with either side's rest; 0 if a side has no words."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    s, l, r = " ".join(both), " ".join(both + left), " ".join(both + right)
    return max(ratio(l, r), ratio(s, l) if both else 0.0, ratio(s, r) if both else 0.0)


def _column(f):
    def of(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def run(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

        return run(a, b)

    return of


ratio_of, token_sort_of, token_set_of = _column(ratio), _column(token_sort), _column(token_set)


def common_sql(a: str, b: str) -> str:
    """The longest common subsequence's length of two texts as DuckDB says it, by folding the rows of the table."""
    row = f"list_transform(range(0, length({b}) + 1), lambda i: 0::BIGINT)"
    cell = f"list_append(acc, CASE WHEN unicode(substr({b}, j[1], 1)) = x[1] THEN row_[j[1]] + 1 ELSE greatest(row_[j[1] + 1], acc[-1]) END)"
    inner = f"list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda acc, j: {cell})"
    return f"list_reduce(list_prepend({row}, list_transform(list_filter(string_split({a}, ''), lambda c: c <> ''), lambda c: [unicode(c)::BIGINT])), lambda row_, x: {inner})[-1]"


def ratio_sql(a: str, b: str) -> str:
    """``ratio`` as DuckDB says it."""
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN CASE WHEN {a} = {b} THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END ELSE 200.0::DOUBLE * {common_sql(a, b)} / (length({a}) + length({b})) END)"


def sorted_sql(a: str) -> str:
    """A text's words in order, as DuckDB says it."""
    return f"array_to_string(list_sort(list_filter(string_split_regex({a}, '\\s+'), lambda w: w <> '')), ' ')"


def token_set_sql(a: str, b: str) -> str:
    """``token_set`` as DuckDB says it."""
    words = lambda t: f"list_sort(list_distinct(list_filter(string_split_regex({t}, '\\s+'), lambda w: w <> '')))"
    x, y = words(a), words(b)
    both, left, right = f"list_filter({x}, lambda w: list_contains({y}, w))", f"list_filter({x}, lambda w: NOT list_contains({y}, w))", f"list_filter({y}, lambda w: NOT list_contains({x}, w))"
    s, l, r = (f"array_to_string({v}, ' ')" for v in (both, f"list_concat({both}, {left})", f"list_concat({both}, {right})"))
    best = f"greatest({ratio_sql(l, r)}, CASE WHEN len({both}) > 0 THEN greatest({ratio_sql(s, l)}, {ratio_sql(s, r)}) ELSE 0.0 END)"
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0::DOUBLE WHEN len({both}) > 0 AND (len({left}) = 0 OR len({right}) = 0) THEN 100.0::DOUBLE ELSE {best} END)"
