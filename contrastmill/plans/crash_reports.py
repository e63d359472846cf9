"""Feature set for software crash reports."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import functions as F

from contrastmill.functions import scalars
from contrastmill.operators.features import (
    FeatureSet,
    FeatureSpec,
    addon_family,
    module_family,
    text_family,
)

# Raw, free-text and identifier columns that are no attributes.
DROPPED = (
    "total_virtual_memory", "total_physical_memory", "available_virtual_memory",
    "available_physical_memory", "oom_allocation_size", "memory_ghost_windows",
    "memory_top_none_detached", "app_notes", "graphics_critical_error", "addons", "date",
    "cpu_info", "user_comments", "uuid", "json_dump", "additional_minidumps", "classifications",
    "crash_id", "java_stack_trace", "last_crash", "install_age", "memory_measures",
    "memory_report", "uptime", "winsock_lsp", "version", "topmost_filenames", "proto_signature",
    "processor_notes", "product", "productid",
)

# The only attributes modules may pair with.
MODULE_PARTNERS = ("platform", "platform_pretty_version", "platform_version", "startup_crash")

# Which attribute may explain which; @name stands for a family of features.
PRIORS = {
    "platform": (
        "platform_pretty_version", "adapter_vendor_id", "bios_manufacturer", "CPU Info",
        "cpu_arch", "os_arch",
    ),
    "platform_pretty_version": ("platform_version", "@app_note"),
    "platform_version": ("@module",),
    "adapter_vendor_id": ("adapter_device_id",),
    "adapter_device_id": (
        "adapter_driver_version", "adapter_driver_version_clean", "adapter_subsys_id",
    ),
    "adapter_driver_version": ("@app_note", "@gfx_error"),
    "adapter_driver_version_clean": ("@app_note", "@gfx_error"),
    "cpu_arch": ("CPU Info",),
    "CPU Info": ("cpu_microcode_version",),
    "startup_crash": (
        "@addon", "@addon-version", "@module", "os_arch", "shutdown_progress", "safe_mode",
        "ipc_channel_error", "ipc_fatal_error_protocol", "gmp_plugin", "jit_category",
        "accessibility", "useragent_locale", "adapter_vendor_id", "adapter_device_id",
        "adapter_subsys_id", "theme", "e10s_enabled", "e10s_cohort", "bios_manufacturer",
        "process_type", "@app_note",
    ),
    "process_type": ("e10s_enabled", "startup_crash"),
    "android_hardware": ("@module",),
    "android_board": ("@module",),
    "android_manufacturer": ("@module",),
}


def crash_features(
    app_notes: Iterable[str] = (),
    gfx_errors: Iterable[str] = (),
    *,
    known_app_notes: Iterable[str] | None = None,
    known_gfx_errors: Iterable[str] | None = None,
    known_addons: Iterable[str] | None = None,
    memory_is_text: bool = True,
) -> FeatureSet:
    """Attributes of a crash report.

    ``app_notes`` and ``gfx_errors`` are dictionaries to search the texts for; the ``known_*``
    lists name features to use as they are, without a search for frequent ones.
    """
    c = F.col
    specs = (
        FeatureSpec(("plugin_version",), "plugin", scalars.not_null_flag(c("plugin_version"))),
        FeatureSpec(("app_notes",), "has dual GPUs", scalars.contains_text(c("app_notes"), "Has dual GPUs")),
        FeatureSpec(
            ("total_virtual_memory", "platform", "platform_version"), "os_arch",
            scalars.os_arch(c("total_virtual_memory"), c("platform"), c("platform_version"), memory_is_text),
        ),
        FeatureSpec(
            ("adapter_vendor_id", "adapter_driver_version"), "adapter_driver_version_clean",
            scalars.driver_version_clean(c("adapter_vendor_id"), c("adapter_driver_version")),
        ),
        FeatureSpec(("cpu_info",), "CPU Info", scalars.cpu_info(c("cpu_info"))),
        FeatureSpec(("cpu_info",), "Is Multicore", scalars.is_multicore(c("cpu_info"))),
        FeatureSpec(("memory_ghost_windows",), "ghost_windows > 0", scalars.positive_flag(c("memory_ghost_windows"))),
        FeatureSpec(
            ("memory_top_none_detached",), "top(none)/detached > 0",
            scalars.positive_flag(c("memory_top_none_detached")),
        ),
    )
    families = (
        addon_family("addons", known=known_addons),
        module_family(
            scalars.module_names(c("json_dump.modules.list")), ("json_dump",), partners=MODULE_PARTNERS,
            record_id="uuid",
        ),
        text_family("app_notes", app_notes, "app_note", '"%s" in app_notes', known_app_notes),
        text_family("graphics_critical_error", gfx_errors, "gfx_error", 'GFX_ERROR "%s"', known_gfx_errors),
    )
    return FeatureSet(
        specs=specs,
        families=families,
        drop=(*DROPPED, "signature"),
        renames=(("dom_ipc_enabled", "e10s_enabled"),),
        only_true=("submitted_from_infobar",),
        edges=tuple((a, b) for a, targets in PRIORS.items() for b in targets),
    )
