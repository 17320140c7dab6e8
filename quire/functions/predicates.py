"""Boolean column expressions and keyword search over label-like fields."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def null_empty(col) -> Column:
    """Present and not empty."""
    return _col(col).isNotNull() & (F.length(_col(col)) > 0)


def contains_ci(col, *terms: str) -> Column:
    """Every term occurs, ignoring case."""
    low = F.lower(_col(col))
    return reduce(lambda a, b: a & b, [low.contains(t.lower()) for t in terms])


def exists_nested(col, pred: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.exists(_col(col), pred), F.lit(False))


def _alternatives(query: str) -> list[list[str]]:
    """``a AND b OR c`` as [[a, b], [c]]: AND binds tighter, case of the operators is free, no parentheses."""
    pieces = re.split(r" (and|or) ", re.sub(r"\s+", " ", query.strip()), flags=re.IGNORECASE)
    groups = [[pieces[0].strip().lower()]]
    for op, term in zip(pieces[1::2], pieces[2::2]):
        if op.lower() == "and":
            groups[-1].append(term.strip().lower())
        else:
            groups.append([term.strip().lower()])
    return groups


def _search_columns(query: str, fields: list[str], rename=lambda f: f) -> tuple[Column, Column, Column]:
    """(matches, match_fields, matched_terms) for a query over ``fields``."""
    if query.strip() in ("", "AND", "OR"):
        none = F.array().cast("array<string>")
        return F.lit(False), none, none
    groups = _alternatives(query)
    terms = list(dict.fromkeys(t for g in groups for t in g))
    hit = {t: {f: F.coalesce(F.lower(F.col(f)).contains(t), F.lit(False)) for f in fields} for t in terms}
    any_field = {t: reduce(lambda a, b: a | b, hit[t].values()) for t in terms}
    matches = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [any_field[t] for t in g]) for g in groups])
    match_fields = F.array_compact(F.array(*[
        F.when(reduce(lambda a, b: a | b, [hit[t][f] for t in terms]), F.lit(rename(f))) for f in fields]))
    matched_terms = F.array_compact(F.array(*[F.when(any_field[t], F.lit(t)) for t in terms]))
    return matches, match_fields, matched_terms


def boolean_query_search(df: DataFrame, query: str, fields=("label", "type"), limit: int | None = None,
                         order_by: str = "idx") -> DataFrame:
    """Rows matching a search string, with the fields and terms that matched; with a ``limit`` the first in ``order_by`` order."""
    matches, match_fields, matched_terms = _search_columns(query, list(fields))
    found = df.where(matches).withColumn("match_fields", match_fields).withColumn("matched_terms", matched_terms)
    return found if limit is None else found.orderBy(order_by).limit(limit)


def pair_search(pairs: DataFrame, query: str, label_filter: str = "all", limit: int | None = None,
                fields=("label", "type"), order_by=("idx_l", "idx_r")) -> DataFrame:
    """Labelled pairs (columns ``<field>_l``, ``<field>_r``, ``pair_label``) where either side matches."""
    left, left_fields, _ = _search_columns(query, [f"{f}_l" for f in fields], lambda f: f[:-2])
    right, right_fields, _ = _search_columns(query, [f"{f}_r" for f in fields], lambda f: f[:-2])
    wanted = ["match", "distinct"] if label_filter == "all" else [label_filter]
    found = (pairs.where(F.col("pair_label").isin(wanted))
             .withColumn("record1_matches", left).withColumn("record2_matches", right)
             .withColumn("record1_match_fields", left_fields).withColumn("record2_match_fields", right_fields)
             .where("record1_matches OR record2_matches"))
    # matching pairs are listed before distinct ones
    return found if limit is None else found.orderBy(F.desc("pair_label"), *order_by).limit(limit)


def metadata_prefilter(df: DataFrame, wanted: dict) -> DataFrame:
    """Equality filter on metadata columns; a list means any of its values."""
    for name, value in wanted.items():
        df = df.where(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == F.lit(value))
    return df
