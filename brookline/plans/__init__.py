"""Graphs of named flows."""

from .graph import Graph, Stage, multi_run, run, run_simple, stage, stage_name, tap_name, to_dot

__all__ = ["Graph", "Stage", "multi_run", "run", "run_simple", "stage", "stage_name", "tap_name", "to_dot"]
