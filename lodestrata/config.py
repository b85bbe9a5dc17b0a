"""Configuration: strict YAML, environment overlay, validation last."""

from __future__ import annotations

import dataclasses
import os
import types
import typing
from dataclasses import dataclass, field

import yaml

from lodestrata.functions.hashing import check_algorithm
from lodestrata.functions.times import duration_seconds

MODES = ("report_only", "pointer")


@dataclass
class Bucket:
    name: str = ""
    prefix: str = ""


@dataclass
class Storage:
    endpoint: str = ""
    region: str = ""
    access_key: str = ""
    secret_key: str = ""
    use_path_style: bool = False
    secure: bool = False
    buckets: list[Bucket] = field(default_factory=list)


@dataclass
class Dedup:
    hash_algo: str = "sha256"
    min_size_bytes: int = 0
    blob_prefix: str = "blobs/"
    mode: str = "report_only"
    delete_originals: bool = False
    force: bool = False
    collect_after: int = 0  # epochs from a blob's mark as unreferenced to its removal; 0 removes at once


@dataclass
class Cache:
    backend: str = "sqlite"
    path: str = ""


@dataclass
class Schedule:
    scan_interval: str = "1h"
    workers: int | None = None  # calls at a time: by default one for each core, two at most


@dataclass
class Logging:
    level: str = "info"
    file: str = ""


@dataclass
class Config:
    s3: Storage = field(default_factory=Storage)
    dedup: Dedup = field(default_factory=Dedup)
    cache: Cache = field(default_factory=Cache)
    schedule: Schedule = field(default_factory=Schedule)
    logging: Logging = field(default_factory=Logging)

    @property
    def scopes(self) -> list[tuple[str, str]]:
        return [(b.name, b.prefix) for b in self.s3.buckets]

    @property
    def interval_seconds(self) -> float:
        return duration_seconds(self.schedule.scan_interval)

    def s3a_options(self) -> dict[str, str]:
        """Hadoop settings for reading the same storage through s3a."""
        s = self.s3
        return {
            "spark.hadoop.fs.s3a.endpoint": s.endpoint, "spark.hadoop.fs.s3a.endpoint.region": s.region,
            "spark.hadoop.fs.s3a.access.key": s.access_key, "spark.hadoop.fs.s3a.secret.key": s.secret_key,
            "spark.hadoop.fs.s3a.path.style.access": str(s.use_path_style).lower(), "spark.hadoop.fs.s3a.connection.ssl.enabled": str(s.secure).lower(),
        }

    def validate(self) -> Config:
        d = self.dedup
        if d.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, got {d.mode!r}")
        if self.cache.backend != "sqlite":
            raise ValueError(f"cache backend must be sqlite, got {self.cache.backend!r}")
        check_algorithm(d.hash_algo)
        if not d.blob_prefix:
            raise ValueError("blob_prefix must not be empty")
        if d.min_size_bytes < 0:
            raise ValueError("min_size_bytes must not be negative")
        if d.collect_after < 0:
            raise ValueError("collect_after must not be negative")
        if self.interval_seconds <= 0:
            raise ValueError("scan interval must be > 0")
        return self


def _build(kind, value, where: str):
    if dataclasses.is_dataclass(kind):
        if value is None:
            return kind()
        if not isinstance(value, dict):
            raise ValueError(f"{where}: expected a mapping")
        hints, known = typing.get_type_hints(kind), {f.name for f in dataclasses.fields(kind)}
        if unknown := sorted(set(map(str, value)) - known):
            raise ValueError(f"{where or 'top level'}: unknown key {unknown[0]!r}")
        return kind(**{k: _build(hints[k], v, f"{where}.{k}".strip(".")) for k, v in value.items()})
    if isinstance(kind, types.GenericAlias):
        if not isinstance(value, list):
            raise ValueError(f"{where}: expected a list")
        return [_build(typing.get_args(kind)[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if kind is str and isinstance(value, (int, float)) and not isinstance(value, bool):
        return str(value)
    if isinstance(kind, types.UnionType):
        kind = typing.get_args(kind)[0]
    if type(value) is not kind:
        raise ValueError(f"{where}: expected {kind.__name__}, got {type(value).__name__}")
    return value


#: Environment variables that override the file.
ENVIRONMENT = {"S3_ACCESS_KEY": ("s3", "access_key"), "S3_SECRET_KEY": ("s3", "secret_key")}


def parse(text: str, environment: dict[str, str] | None = None) -> Config:
    config = _build(Config, yaml.safe_load(text), "")
    environment = os.environ if environment is None else environment
    for name, (part, key) in ENVIRONMENT.items():
        if name in environment:
            setattr(getattr(config, part), key, environment[name])
    return config.validate()


def load(path: str, environment: dict[str, str] | None = None) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read(), environment)
