"""Configuration files: repositories to scan, project settings, false-positive log.

These are small documents a person writes; they are read on the driver.
"""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .schemas import FALSE_POSITIVES

SETTINGS_FILE = "tracewright.toml"
IGNORE_FILE = ".tracewrightignore"
FP_FIELDS = ("finding_id", "rule_id", "rule_version", "repo", "file", "function", "code_location_hash", "reason")


@dataclass(frozen=True)
class Repo:
    id: str
    path: str
    enabled: bool = True


@dataclass(frozen=True)
class ScanConfig:
    repos: tuple[Repo, ...] = ()
    findings_dir: str = "findings"
    fp_log: str = "findings/fp-log.yaml"
    output_format: str = "yaml"
    timeout_seconds: int = 300
    max_retries: int = 3

    def folders(self) -> dict[str, str]:
        return {r.id: r.path for r in self.repos if r.enabled}


def load_scan_config(path: str) -> ScanConfig:
    import yaml

    with open(path, encoding="utf-8") as handle:
        data = yaml.safe_load(handle)
    if not isinstance(data, dict):
        raise ValueError(f"configuration must be a mapping, not {type(data).__name__}")
    repos: dict[str, Repo] = {}
    for entry in data.get("repos") or []:
        if isinstance(entry, dict):
            name = entry.get("id")
            if not name:
                raise ValueError(f"repository without id: {entry.get('path')}")
            if name in repos:
                raise ValueError(f"repository id used twice: {name}")
            repos[name] = Repo(name, entry["path"], entry.get("enabled", True))
    given = {k: data[k] for k in ("findings_dir", "fp_log", "output_format") if k in data}
    numbers = {k: int(data[k]) for k in ("timeout_seconds", "max_retries") if k in data}
    return ScanConfig(tuple(repos.values()), **given, **numbers)


@dataclass
class ProjectSettings:
    exclude_paths: list[str] = field(default_factory=list)
    disabled_rules: list[str] = field(default_factory=list)
    min_severity: str = "low"
    fail_on: str = "critical"
    baseline_path: str | None = None


def load_project_settings(root: str) -> ProjectSettings:
    """Settings of a project; an unreadable settings file means defaults."""
    settings = ProjectSettings()
    named, listed = os.path.join(root, SETTINGS_FILE), os.path.join(root, IGNORE_FILE)
    if os.path.isfile(named):
        try:
            with open(named, "rb") as handle:
                data = tomllib.load(handle)
        except (tomllib.TOMLDecodeError, UnicodeDecodeError):
            return settings
        section = data.get("tool", {}).get("tracewright", data.get("tracewright", {}))
        settings.exclude_paths = list(section.get("exclude", []))
        settings.disabled_rules = list(section.get("disabled_rules", []))
        settings.min_severity = str(section.get("min_severity", settings.min_severity))
        settings.fail_on = str(section.get("fail_on", settings.fail_on))
        if "baseline" in section:
            settings.baseline_path = os.path.join(root, section["baseline"])
    elif os.path.isfile(listed):
        with open(listed, encoding="utf-8") as handle:
            lines = [line.strip() for line in handle.read().splitlines()]
        settings.exclude_paths = [line for line in lines if line and not line.startswith("#")]
    return settings


def load_false_positives(spark: SparkSession, path: str) -> DataFrame:
    """The log of known false positives; every entry must be complete."""
    import yaml

    with open(path, encoding="utf-8") as handle:
        entries = (yaml.safe_load(handle) or {}).get("false_positives", [])
    if not isinstance(entries, list):
        raise ValueError("false_positives must be a list")
    rows = []
    for entry in entries:
        if not isinstance(entry, dict):
            raise ValueError("a false positive must be a mapping")
        missing = [f for f in FP_FIELDS if not isinstance(entry.get(f), str) or not entry[f]]
        if missing:
            raise ValueError(f"false positive without {', '.join(missing)}")
        rows.append(tuple(entry[f] for f in FP_FIELDS))
    return spark.createDataFrame(sorted(rows), FALSE_POSITIVES)


def _changed(folder: str, reference: str) -> list[str] | None:
    import subprocess

    try:
        done = subprocess.run(["git", "diff", "--name-only", reference], cwd=folder, capture_output=True, text=True, check=True, timeout=30)
    except (OSError, subprocess.SubprocessError):
        return None
    return [line for line in done.stdout.splitlines() if line]


def changed_files(spark: SparkSession, repo: str, reference: str) -> DataFrame | None:
    """Paths changed since a git reference, or None (no filter) when git cannot tell."""
    paths = _changed(repo, reference)
    return None if paths is None else spark.createDataFrame([(path,) for path in paths], "path string")


def changed_in(spark: SparkSession, repos: dict[str, str], reference: str) -> DataFrame:
    """(repo, path) of each repository's own changes; a repository that git cannot tell
    about gets the empty path, which every file ends with."""
    rows = []
    for repo, folder in repos.items():
        paths = _changed(folder, reference)
        rows += [(repo, path) for path in ([""] if paths is None else paths)]
    return spark.createDataFrame(rows, "repo string, path string")
