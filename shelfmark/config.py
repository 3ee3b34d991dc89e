"""Settings of a run: defaults, JSON files, and the precedence of provider settings."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Selection:
    """How candidates are gated, scored and ranked."""

    strategy: str = "collect_and_select"
    provider_hierarchy: list[str] = field(default_factory=list)
    min_title_score: float = 85.0
    creator_weight: float = 0.2
    year_tolerance: int = 10
    max_candidates_per_provider: int = 5
    method: str = "token_set"

    @classmethod
    def of(cls, config: dict) -> Selection:
        """From the ``selection`` part of a configuration; unreadable numbers keep their defaults."""
        given, out = config.get("selection") or {}, cls()
        for f in fields(cls):
            value = given.get(f.name)
            if value is None:
                continue
            kind = type(getattr(out, f.name))
            try:
                setattr(out, f.name, kind(value))
            except (TypeError, ValueError):
                pass
        return out


def load_config(path: str | os.PathLike | None, example: str | os.PathLike | None = None) -> dict:
    """The JSON object at ``path``, else at ``example``.

    Raises FileNotFoundError where neither is there and ValueError where the text is no JSON object.
    """
    for place in (path, example):
        if place and Path(place).exists():
            try:
                found = json.loads(Path(place).read_text(encoding="utf-8"))
            except json.JSONDecodeError as e:
                raise ValueError(f"{place} is not valid JSON: {e}") from e
            if not isinstance(found, dict):
                raise ValueError(f"{place} holds no JSON object")
            return found
    raise FileNotFoundError(str(path))


# A settings key that another provider key may stand for.
ALIASES = {"bnf_gallica": "gallica"}


def provider_setting(config: dict, provider: str, name: str, default=None):
    """A provider's own setting; its alias counts only where the provider has no entry itself."""
    settings = config.get("provider_settings") or {}
    own = settings.get(provider)
    if own is None and provider in ALIASES:
        own = settings.get(ALIASES[provider])
    return (own or {}).get(name, default)


def number(value) -> float | None:
    try:
        return float(value)
    except (TypeError, ValueError):
        return None


def min_title_score(config: dict, provider: str | None, default: float) -> float:
    """Provider setting, else selection setting, else ``default``; what is no number falls through."""
    given = [provider_setting(config, provider, "min_title_score") if provider else None, (config.get("selection") or {}).get("min_title_score")]
    return next((n for v in given if (n := number(v)) is not None), default)


def search_timeout(config: dict, provider: str | None, default: float | None) -> float | None:
    """Seconds, or None for no limit: the provider's key if it is there, else the selection's; 0 or null disables."""
    absent = object()
    for value in (provider_setting(config, provider, "search_timeout_seconds", absent) if provider else absent, (config.get("selection") or {}).get("search_timeout_seconds", absent)):
        if value is absent:
            continue
        if value is None:
            return None
        if (n := number(value)) is not None:
            return n if n > 0 else None
    return default


# Request policy of a provider that sets none.
NETWORK_DEFAULTS = {
    "max_attempts": 5, "base_backoff_s": 1.5, "backoff_multiplier": 1.5, "max_backoff_s": 60.0, "timeout_s": 30.0,
    "circuit_breaker_enabled": True, "circuit_breaker_threshold": 3, "circuit_breaker_cooldown_s": 300.0,
}


def network_policy(config: dict, provider: str) -> dict:
    """The provider's request policy over the defaults; an old top-level ``delay_ms`` counts where the policy has none."""
    own = provider_setting(config, provider, "network") or {}
    old = provider_setting(config, provider, "delay_ms")
    return NETWORK_DEFAULTS | {"delay_ms": old or 0, "jitter_ms": 0} | own


# Providers that need a key, and the variable that holds it.
KEY_VARIABLES = {"europeana": "EUROPEANA_API_KEY", "dpla": "DPLA_API_KEY", "ddb": "DDB_API_KEY", "google_books": "GOOGLE_BOOKS_API_KEY"}


def with_keys(providers: list[str], names: dict[str, str] | None = None, environment=os.environ) -> tuple[list[str], list[str]]:
    """(usable providers, those whose key is missing); ``names`` may rename the variables."""
    variables = KEY_VARIABLES | {k: v for k, v in (names or {}).items() if k in KEY_VARIABLES}
    missing = [p for p in providers if p in variables and not environment.get(variables[p])]
    return [p for p in providers if p not in missing], missing


def provider_order(enabled: list[str], hierarchy: list[str]) -> list[str]:
    """Listed and enabled providers in list order, then the other enabled ones in their own order."""
    first = [p for p in dict.fromkeys(hierarchy) if p in enabled]
    return first + [p for p in dict.fromkeys(enabled) if p not in first]


def split_names(text: str | None) -> list[str]:
    """The names of a comma-separated list, once each."""
    return list(dict.fromkeys(x.strip() for x in (text or "").split(",") if x.strip()))


def override_providers(enabled: list[str], known: list[str], only: str | None = None, enable: str | None = None, disable: str | None = None) -> tuple[list[str], list[str]]:
    """(providers, unknown names): an explicit list replaces, ``enable`` appends, ``disable`` removes."""

    asked = split_names(only) + split_names(enable) + split_names(disable)
    out = split_names(only) or list(enabled)
    out = list(dict.fromkeys([p for p in out + split_names(enable) if p in known]))
    return [p for p in out if p not in split_names(disable)], [p for p in dict.fromkeys(asked) if p not in known]


def resolve_settings(rows: DataFrame, settings: DataFrame, provider_col: str, names: list[str]) -> DataFrame:
    """Adds each named setting of the row's provider; the alias' row counts where the provider has none.

    ``settings`` has one row per provider_key and a column per name; it is a dimension of
    at most a few dozen rows, and Spark broadcasts it by its size.
    """
    own = settings.select(F.col("provider_key").alias("_own"), F.struct(*names).alias("_s"))
    other = settings.select(F.col("provider_key").alias("_other"), F.struct(*names).alias("_a"))
    alias: Column = F.lit(None).cast("string")
    for key, stands_for in ALIASES.items():
        alias = F.when(F.col(provider_col) == key, stands_for).otherwise(alias)
    out = rows.join(own, F.col(provider_col) == F.col("_own"), "left").join(other, alias == F.col("_other"), "left")
    chosen = {n: F.when(F.col("_own").isNotNull(), F.col(f"_s.{n}")).otherwise(F.col(f"_a.{n}")) for n in names}
    return out.withColumns(chosen).drop("_own", "_other", "_s", "_a")


def resolved_threshold(own: Column, general: Column, default: float) -> Column:
    """The first of two texts that is a number, else the default."""
    return F.coalesce(own.try_cast("double"), general.try_cast("double"), F.lit(float(default)))


# Download settings that a configuration leaves out.
DOWNLOAD_DEFAULTS = {
    "prefer_pdf_over_images": True, "download_manifest_renderings": True, "max_renderings_per_manifest": 1, "rendering_mime_whitelist": ["application/pdf", "application/epub+zip"],
    "overwrite_existing": False, "include_metadata": True,
}
RESUME_MODES = ["skip_completed", "reprocess_all", "skip_if_has_objects", "resume_from_csv"]


def download_settings(config: dict) -> dict:
    return DOWNLOAD_DEFAULTS | (config.get("download") or {})


def resume_mode(config: dict) -> str:
    """How finished works are left out; an unknown mode is the first."""
    mode = str((config.get("download") or {}).get("resume_mode") or RESUME_MODES[0]).lower()
    return mode if mode in RESUME_MODES else RESUME_MODES[0]


def whole_number(value, default: int | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return default


def max_pages(config: dict, provider: str) -> int | None:
    """Pages of a work that a provider may give; null for no limit.  Where pages are not named, images are."""
    value = provider_setting(config, provider, "max_pages")
    if value is None:
        value = provider_setting(config, provider, "max_images")
    return whole_number(value, None)


def parallel_downloads(config: dict, override: int | None = None) -> int:
    """Works downloaded side by side, one at least; an override of 0 leaves the setting."""
    return max(1, whole_number(override or (config.get("download") or {}).get("max_parallel_downloads") or 1, 1))
