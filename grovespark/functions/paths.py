"""Paths as columns. A path is relative, with single slashes between its parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column) -> Column:
    """Runs of slashes become one, none at the ends. Dots are parts like others."""
    return F.regexp_replace(F.regexp_replace(path, "/+", "/"), "^/|/$", "")


def parent_path(path: Column) -> Column:
    """What stands before the last slash, or nothing. Of a normalized path."""
    depth = F.char_length(F.regexp_replace(path, "[^/]", ""))
    return F.when(F.instr(path, "/") > 0, F.call_function("substring_index", path, F.lit("/"), depth)).otherwise(F.lit(""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def join_path(folder: Column, name: Column) -> Column:
    """The path of ``name`` in ``folder``; the root folder is empty."""
    return F.when(F.coalesce(folder, F.lit("")) == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def under(path: Column, folder: str) -> Column:
    """The folder itself and all below it; everything for the root."""
    return F.lit(True) if not folder else (path == folder) | F.startswith(path, F.lit(folder + "/"))
