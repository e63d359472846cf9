"""Scalar feature derivations, one column expression each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vendor identifiers as they appear with and without prefix.
INTEL = ("0x8086", "8086")
NVIDIA = ("0x10de", "10de")

# Fixed value: below this much virtual memory the system is a 32-bit one.
FULL_32BIT_SPACE = 2684354560


def contains_text(text: Column, wanted: str) -> Column:
    """Does the text hold the string; null for null text."""
    return text.contains(F.lit(wanted))


def addon_name(entry: Column) -> Column:
    """Text before the first colon; null when there is no colon."""
    return F.when(entry.contains(":"), F.substring_index(entry, ":", 1))


def addon_version_text(entry: Column) -> Column:
    """Text after the first colon; null when there is no colon."""
    return F.when(entry.contains(":"), F.substr(entry, F.instr(entry, ":") + 1))


def addon_presence(entries: Column, name: str) -> Column:
    """Is there an entry ``name:version``; false for a null array."""
    return F.coalesce(F.exists(entries, lambda e: addon_name(e) == F.lit(name)), F.lit(False))


def addon_version(entries: Column, name: str) -> Column:
    """Version in the first entry of that name, ``Not installed`` without one, null for a null array."""
    hits = F.filter(entries, lambda e: addon_name(e) == F.lit(name))
    version = F.coalesce(addon_version_text(F.get(hits, F.lit(0))), F.lit("Not installed"))
    return F.when(entries.isNotNull(), version)


def module_names(modules: Column) -> Column:
    """File names out of a nested module list."""
    return modules["element"]["filename"]


def module_presence(modules: Column, name: str) -> Column:
    return F.array_contains(module_names(modules), name)


def not_null_flag(column: Column) -> Column:
    return column.isNotNull()


def positive_flag(column: Column) -> Column:
    return column > 0


def os_arch(memory: Column, platform: Column, platform_version: Column, memory_is_text: bool = True) -> Column:
    """``x86`` / ``amd64`` from the address space when given, else from the platform text.

    A text is given unless it is empty (``'0'`` is given); a number is given unless it is zero.
    """
    text = F.trim(memory.cast("string"))
    by_memory = (
        F.when(~text.rlike("^[+-]?[0-9]+$"), "unknown")
        .when(text.try_cast("decimal(38,0)") < FULL_32BIT_SPACE, "x86")
        .otherwise("amd64")
    )
    by_platform = (
        F.when(platform == "Mac OS X", "amd64")
        .when(platform_version.contains("i686"), "x86")
        .when(platform_version.contains("x86_64"), "amd64")
    )
    return F.when(memory != ("" if memory_is_text else 0), by_memory).otherwise(by_platform)


def driver_version_clean(vendor: Column, version: Column) -> Column:
    """The part of a driver version its vendor uses publicly."""
    nvidia = F.concat(
        F.substring(version, -6, 1), F.substring(version, -4, 2), F.lit("."), F.substring(version, -2, 2)
    )
    return (
        F.when(version == "", version)
        .when(vendor.isin(*INTEL), F.substring_index(version, ".", -1))
        .when(vendor.isin(*NVIDIA), nvidia)
        .otherwise(version)
    )


def cpu_info(raw: Column) -> Column:
    return F.substring_index(raw, " | ", 1)


def is_multicore(raw: Column) -> Column:
    return F.substring_index(raw, " | ", -1) != "1"


def build_before(build_id: Column, day: str, componentwise: bool = False) -> Column:
    """Is the build older than ``day`` (``yyyymmdd``).

    ``componentwise`` compares year, month and day each on its own and joins them by *or*,
    so that August 2016 counts as before 13 July 2016 when its day is below 13.
    """
    if not componentwise:
        return F.substring(build_id, 1, 8) < day
    parts = ((1, 4), (5, 2), (7, 2))
    tests = [F.substring(build_id, p, n).cast("int") < int(day[p - 1 : p - 1 + n]) for p, n in parts]
    return tests[0] | tests[1] | tests[2]
