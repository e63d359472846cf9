"""Feature columns and families of multi-valued features.

A family stands for many features at once: add-ons out of an array, modules out of a nested
list, strings out of a free text. Its members are found by counting, and stay values of the
item table; they never become columns unless the caller names them beforehand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contrastmill.functions import scalars
from contrastmill.functions.binding import bind
from contrastmill.operators.groups import col

VERSION_SUFFIX = "-version"
NOT_INSTALLED = "Not installed"


@dataclass(frozen=True)
class FeatureSpec:
    """A derived column, added when all its inputs are there."""

    inputs: tuple[str, ...]
    key: str
    column: Column


@dataclass(frozen=True)
class Family:
    name: str
    inputs: tuple[str, ...]
    label: str
    present: Callable[[], Column]  # array of the members a row has, each once
    flag: Callable[[str], Column]  # does the row have this member
    versions: Callable[[], Column] | None = None  # array of (name, value), one per member
    entries: Callable[[], Column] | None = None  # array of ``name:value``, of which both come
    listed: Callable[[], Column] | None = None  # array of the members as it is, with repeats and nulls
    version: Callable[[str], Column] | None = None
    version_label: str = "%s"
    by_reference: bool = True  # is frequent-in-the-reference enough to keep a member
    partners: tuple[str, ...] | None = None  # keys its members may pair with; None is all
    known: tuple[str, ...] | None = None  # members given by the caller instead of found
    record_id: str | None = None  # rows of one id count a member once

    @property
    def version_name(self) -> str:
        return f"{self.name}{VERSION_SUFFIX}"


def entry_names(entries: Column) -> Column:
    """Names out of an array of ``name:value`` entries, each once."""
    return F.array_distinct(F.array_compact(F.transform(entries, scalars.addon_name)))


def entry_versions(entries: Column) -> Column:
    """Name and value of the first entry of every name in an array of ``name:value`` entries."""

    def entry(e: Column, i: Column) -> Column:
        name, value = F.substring_index(e, ":", 1), F.substr(e, F.instr(e, ":") + 1)
        return F.struct(name.alias("name"), i.alias("position"), value.alias("value"))

    def first_of_each(listed: Column) -> Column:
        first = F.zip_with(
            listed,
            F.slice(F.concat(F.array(F.lit(None)), listed), F.lit(1), F.size(listed)),
            lambda e, p: F.when(
                p.isNull() | (p["name"] != e["name"]), F.struct(e["name"].alias("name"), e["value"].alias("value"))
            ),
        )
        return F.array_compact(first)

    # Sorted by name and position, the first entry of a name is the one after another name. Equal
    # entries go first; ``sort_array`` compares without a function, ``array_sort`` calls one.
    parsable = F.array_distinct(F.filter(entries, lambda e: e.contains(":")))
    return bind(F.sort_array(F.transform(parsable, entry)), first_of_each)


def addon_family(column: str = "addons", name: str = "addon", known: Iterable[str] | None = None) -> Family:
    """Members and versions out of an array of ``name:version`` entries."""
    return Family(
        name=name,
        inputs=(column,),
        label='Addon "%s"',
        version_label='Addon "%s" Version',
        present=lambda: entry_names(col(column)),
        flag=lambda member: scalars.addon_presence(col(column), member),
        versions=lambda: entry_versions(col(column)),
        entries=lambda: col(column),
        version=lambda member: scalars.addon_version(col(column), member),
        known=None if known is None else tuple(known),
    )


def module_family(
    names: Column,
    inputs: Sequence[str],
    name: str = "module",
    partners: Sequence[str] | None = None,
    known: Iterable[str] | None = None,
    record_id: str | None = None,
) -> Family:
    """Members out of an array of file names; each counts once per row, or per record if rows can
    share the id named by ``record_id``."""
    return Family(
        name=name,
        inputs=tuple(inputs),
        label='Module "%s"',
        present=lambda: F.array_distinct(F.array_compact(names)),
        listed=lambda: names,
        flag=lambda member: F.array_contains(names, member),
        by_reference=False,
        partners=None if partners is None else tuple(partners),
        known=None if known is None else tuple(known),
        record_id=record_id,
    )


def listed_family(column: str, name: str, label: str, by_reference: bool = True) -> Family:
    """Members are the strings of an array column, as ``patterns.with_pattern_members`` adds one."""
    return Family(
        name=name,
        inputs=(column,),
        label=label,
        present=lambda: F.array_distinct(F.array_compact(col(column))),
        listed=lambda: col(column),
        flag=lambda member: F.array_contains(col(column), member),
        by_reference=by_reference,
    )


def text_family(
    column: str, patterns: Iterable[str], name: str, label: str, known: Iterable[str] | None = None
) -> Family:
    """Members are the strings of a dictionary that a text holds."""
    patterns = tuple(dict.fromkeys(patterns))

    def present() -> Column:
        hits = [F.when(scalars.contains_text(col(column), p), F.lit(p)) for p in patterns]
        return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")

    return Family(
        name=name,
        inputs=(column,),
        label=label,
        present=present,
        flag=lambda member: scalars.contains_text(col(column), member),
        known=None if known is None else tuple(known),
    )


def optional_projection(df: DataFrame, specs: Iterable[FeatureSpec]) -> DataFrame:
    """Add every derived column whose inputs the table has, in one projection."""
    have = set(df.columns)
    wanted = {s.key: s.column for s in specs if have.issuperset(s.inputs)}
    return df.withColumns(wanted) if wanted else df


def rename_legacy_column(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def drop_non_features(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.drop(*names)


@dataclass(frozen=True)
class FeatureSet:
    """What is derived from a record table, and what is dropped from it afterwards."""

    specs: tuple[FeatureSpec, ...] = ()
    families: tuple[Family, ...] = ()
    drop: tuple[str, ...] = ()
    renames: tuple[tuple[str, str], ...] = ()
    only_true: tuple[str, ...] = ()  # keys of which only the true value is of interest
    edges: tuple[tuple[str, str], ...] = field(default=())  # prior graph


def member_column(family: Family) -> str:
    return f"@{family.name}"


def record_column(family: Family) -> str:
    return f"@{family.name}-record"


def version_column(family: Family) -> str:
    return f"@{family.version_name}"


def derive_features(df: DataFrame, features: FeatureSet) -> tuple[DataFrame, tuple[Family, ...]]:
    """Apply a feature set; returns the feature table and the families the table has inputs for.

    Members given by the caller become flag columns (and version columns) like any other
    attribute; families still to be discovered become array columns.
    """
    have = set(df.columns)
    families = tuple(f for f in features.families if have.issuperset(f.inputs))
    added: dict[str, Column] = {s.key: s.column for s in features.specs if have.issuperset(s.inputs)}
    members: dict[str, Column] = {}
    for family in families:
        if family.known is not None:
            added |= {member: family.flag(member) for member in family.known}
            if family.version is not None:
                added |= {member + VERSION_SUFFIX: family.version(member) for member in family.known}
            continue
        if family.record_id not in have and (family.entries or family.listed) is not None:
            # What a row has, each once, is found in batches (``row_items``).
            raw, name = (family.entries, version_column) if family.entries else (family.listed, member_column)
            strings = "array<string>"
            added[name(family)] = F.coalesce(raw().cast(strings), F.array().cast(strings))
            continue
        if family.versions is not None:
            # Versions come one per member, so the members are their names.
            nothing = F.array().cast("array<struct<name:string,value:string>>")
            added[version_column(family)] = F.coalesce(family.versions(), nothing)
            members[member_column(family)] = F.transform(col(version_column(family)), lambda v: v["name"])
        else:
            added[member_column(family)] = F.coalesce(family.present(), F.array().cast("array<string>"))
        if family.record_id in have:
            added[record_column(family)] = col(family.record_id).cast("string")
    df = df.withColumns(added) if added else df
    df = df.withColumns(members) if members else df
    for old, new in features.renames:
        df = rename_legacy_column(df, old, new)
    return drop_non_features(df, features.drop), families
