"""Name -> (query, oracle SQL) for every registered operator query."""

from __future__ import annotations

from . import eval_queries, io_queries, pool_queries, prepare_queries, run_queries

_MODULES = [prepare_queries, eval_queries, run_queries, pool_queries, io_queries]


def all_queries() -> dict:
    out = {}
    for m in _MODULES:
        for k, v in m.QUERIES.items():
            if k in out:
                raise ValueError(f"duplicate query {k}")
            out[k] = v
    return out


def queries() -> dict:
    return {k: v[0] for k, v in all_queries().items()}


def oracle_sql() -> dict:
    return {k: v[1] for k, v in all_queries().items() if v[1] is not None}
