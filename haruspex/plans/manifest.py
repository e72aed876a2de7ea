"""Provenance of a published number: manifests, comparability, and certification."""

from __future__ import annotations

import shutil
import subprocess
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from ..operators.leakage import VERSION


class Incomplete(ValueError):
    pass


@dataclass(frozen=True)
class Decoding:
    """How forecasts were decoded; numbers compare only under equal settings."""

    method: str
    temperature: float
    top_p: float
    max_tokens: int
    samples: int
    seed: int | None

    def __post_init__(self):
        if not self.method.strip() or self.temperature < 0 or not 0 < self.top_p <= 1 or self.max_tokens < 1 or self.samples < 1:
            raise ValueError(f"not a decoding: {self}")

    def comparable(self, other: Decoding) -> bool:
        return self == other


@dataclass(frozen=True)
class Manifest:
    code_version: str
    model_version: str
    corpus_version: str
    detector_version: str
    split: str
    freeze: datetime
    base_release: datetime
    created: datetime
    decoding: Decoding

    def __post_init__(self):
        blank = [k for k in ("code_version", "model_version", "corpus_version", "detector_version") if not getattr(self, k).strip()]
        naive = [k for k in ("freeze", "base_release", "created") if getattr(self, k).tzinfo is None]
        if blank or naive:
            raise Incomplete(f"blank: {blank}, without time zone: {naive}")

    def flat(self) -> dict[str, str]:
        rest = {k: v for k, v in asdict(self).items() if k != "decoding"}
        return {k: v.astimezone(UTC).isoformat() if isinstance(v, datetime) else str(v) for k, v in rest.items()} | {f"decoding.{k}": str(v) for k, v in asdict(self.decoding).items()}


def git_version(folder: str, allow_dirty: bool = False) -> str:
    run = lambda *a: subprocess.run(["git", "-C", folder, *a], capture_output=True, text=True, check=True).stdout.strip()
    if not allow_dirty and run("status", "--porcelain"):
        raise RuntimeError("the working tree has changes that aren't committed")
    return run("rev-parse", "HEAD")


def build(folder: str, **fields) -> Manifest:
    """A manifest whose code and detector versions are read, not given."""
    return Manifest(code_version=git_version(folder), detector_version=VERSION, created=datetime.now(UTC), **fields)


def certify(metrics: dict, manifest: Manifest, freeze: datetime) -> dict:
    """metrics with their manifest, if split and freeze are those of the manifest and the model is no newer than the freeze."""
    if metrics.get("split") != manifest.split:
        raise ValueError(f"metrics are of {metrics.get('split')}, the manifest of {manifest.split}")
    if manifest.freeze != freeze:
        raise ValueError("freezes differ")
    if manifest.base_release > freeze:
        raise ValueError("the base model is newer than the freeze")
    return metrics | {"manifest": manifest.flat()}


def require_free_space(path: str, gigabytes: float) -> float:
    free = shutil.disk_usage(path).free / 1e9
    if free < gigabytes:
        raise OSError(f"{free:.1f} GB free, {gigabytes} asked")
    return free
