"""Relational operators as DataFrame transformations."""

from .relational import (
    aggregate,
    anti_join,
    asof_join,
    collect,
    filter_rows,
    hash_join,
    limit,
    nested_loop_join,
    order_by,
    project,
    radix_join,
    range_join,
    replicated_join,
    same_rows,
    scan,
    semi_join,
    size_in_bytes,
    tiled_join,
)

__all__ = [
    "aggregate", "anti_join", "asof_join", "collect", "filter_rows", "hash_join", "limit", "nested_loop_join", "order_by", "project", "radix_join", "range_join",
    "replicated_join", "same_rows", "scan", "semi_join", "size_in_bytes", "tiled_join",
]
