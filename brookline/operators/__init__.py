"""Operators of flows; each function here makes a function Flow -> Flow (or, for joins, of two flows)."""

from .columns import (
    add_column, add_column_regex, add_columns, add_columns_regex, cleanup_input, drop_columns, fast_map, fill_columns, identity, keep_columns, line_splitter, map_add, map_rows,
    partial_schema_apply, partial_schema_apply_if_exists, rename_columns, rename_columns_by, reorder_columns_by, schema_apply, simple_map, simple_map_add, split_line_on_comma,
    split_line_on_tab, strip_quotes, to_lower, trim_whitespace, update_column, update_int_column, update_string_column,
)
from .filters import assign_unique_ids, column_max, downsample, filter_column, filter_rows, fold, limit, simple_filter, take_while
from .grouping import aggregate, collect_by, group
from .joins import (
    FULL, INNER, LARGE, LEFT, ORDERED, SMALL, explode_inner, join, join_as_column, join_collate, join_collate_ordered, join_collate_ordered_rows, join_collate_sum, multi_join,
    sequence_field_merge, sequential_merge,
)
from .nested import add_inner_columns, add_outer_column, flatten, inner_pipe, nested_pipe, rename_inner_columns, sort_nested_by, update_nested
from .ordering import assume_ordering, expect_ordering, sort_by_key
from .probes import assert_probe, print_probe, print_schema_probe, print_status, probe
from .window import sliding_window

__all__ = [n for n in dir() if not n.startswith("_")]
