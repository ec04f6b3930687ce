"""Cleaning of raw process fields and masking of command lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\0"

# Patterns that decide what a field or token means.
DELETED_SUFFIX = r"( \(deleted\))+\z"
EDGE_SPACE = r"^(?U:\s+)|(?U:\s+)\z"
SPACE_RUN = r"(?U)\s+"
UID_LINE = r"(?dm)^Uid:(.*)$"
FIRST_WORD = r"(?U)^\s*(\S+)"
U32 = r"^\+?[0-9]+\z"
CGROUP_LINE = r"(?dm)^[^:\n]*:[^:\n]*:(.*?)\r?$"
UUID = r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}\z"
FLOAT = r"^(?i:[+-]?(?:inf|infinity|nan|(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?))\z"
VOLATILE_DIRS = ("/tmp/", "/proc/")
U32_MAX = 4294967295


def clean_exe(exe: Column) -> Column:
    return F.regexp_replace(exe, DELETED_SUFFIX, "")


def clean_comm(comm: Column) -> Column:
    return F.regexp_replace(comm, EDGE_SPACE, "")


def cut_at_nul(text: Column) -> Column:
    return F.substring_index(text, NUL, 1)


def join_arguments(cmdline: Column) -> Column:
    """NUL separated arguments as one line; empty arguments vanish."""
    parts = F.split(cmdline, r"\x00")
    return F.array_join(F.filter(parts, lambda part: part != ""), " ")


def real_uid(status: Column) -> Column:
    """Real user number from a process status text, NULL when it has none."""
    word = F.regexp_extract(F.regexp_extract(status, UID_LINE, 1), FIRST_WORD, 1)
    number = F.when(word.rlike(U32), word).try_cast("decimal(38,0)")
    return F.when(number <= U32_MAX, number.try_cast("long"))


def cgroup_path(cgroup: Column) -> Column:
    """Third field of the first line that has one, else the empty string."""
    return F.regexp_extract(cgroup, CGROUP_LINE, 1)


def _mask(token: Column) -> Column:
    return (
        F.when(F.contains(token, F.lit("=")), F.concat(F.substring_index(token, "=", 1), F.lit("=<v>")))
        .when(token.rlike(UUID), "<uuid>")
        .when(token.startswith(VOLATILE_DIRS[0]) | token.startswith(VOLATILE_DIRS[1]), "<path>")
        .when(token.rlike(FLOAT), "<n>")
        .otherwise(token)
    )


def normalize_cmdline(cmdline: Column) -> Column:
    """Mask what changes from run to run, keep what tells programs apart."""
    tokens = F.filter(F.split(cmdline, SPACE_RUN), lambda token: token != "")
    return F.array_join(F.transform(tokens, _mask), " ")


def ancestors(path: Column) -> Column:
    """The path itself and every directory above it, ``/`` included."""
    parts = F.split(path, "/")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
    )
    return F.array_distinct(F.transform(prefixes, lambda p: F.when(p == "", "/").otherwise(p)))
