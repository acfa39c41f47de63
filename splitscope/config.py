"""Analysis settings: plain dataclasses, checked where they are read."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field, replace
from pathlib import Path
from typing import Any

VARIANTS = ("default", "tuned", "tuned_ensemble")
DIRECTIONS = (None, "positive", "negative")
PROBLEM_TYPES = ("regression", "binary", "multiclass")
UNITS = ("dataset", "fold")
BACKENDS = ("process", "thread")
COMPONENTS = ("irreg_min_cov_eig", "irreg_std_skew", "irreg_range_skew", "irreg_iqr_hmean", "irreg_kurtosis_std")


class ConfigError(ValueError):
    """A setting is missing or has a value that is not allowed."""


@dataclass(frozen=True)
class Family:
    name: str
    config_types: frozenset[str]
    label: str


@dataclass(frozen=True)
class Comparison:
    name: str
    a: Family
    b: Family
    expected_direction: str | None = None


@dataclass(frozen=True)
class Analysis:
    unit: str = "dataset"
    error_column: str = "metric_error"
    selection_error_column: str | None = "metric_error_val"
    method_variant: tuple[str, ...] = ("tuned",)
    exclude_methods_containing: tuple[str, ...] = ()
    exclude_problem_types: tuple[str, ...] = ()
    folds_per_repeat: int = 3

    @property
    def selection(self) -> str:
        return self.selection_error_column or self.error_column

    @property
    def metrics(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((self.error_column, self.selection)))


@dataclass(frozen=True)
class Descriptors:
    feature_sets: tuple[str, ...] = ("basic", "irregularity")
    external_groups: tuple[str, ...] = ("general", "statistical", "info-theory")
    external_summary: tuple[str, ...] = ("mean", "sd")
    external_timeout_s: float | None = None
    retry_failed: bool = False
    trace: bool = False
    irregularity_components: tuple[str, ...] = COMPONENTS


@dataclass(frozen=True)
class Statistics:
    correlation_method: str = "spearman"
    alpha: float = 0.05
    fdr_method: str | None = "bh"
    confidence_interval: bool = True
    ci_bootstrap_samples: int = 10_000
    ci_confidence_level: float = 0.95
    multivariate: bool = False
    multivariate_method: str = "ols"


@dataclass(frozen=True)
class Cache:
    enabled: bool = True
    directory: str = ".stage_cache"
    stages: frozenset[str] = frozenset({"raw_results", "metafeatures", "gaps", "statistics"})


@dataclass(frozen=True)
class Config:
    version: int
    families: dict[str, Family]
    comparisons: tuple[Comparison, ...]
    analysis: Analysis = field(default_factory=Analysis)
    descriptors: Descriptors = field(default_factory=Descriptors)
    statistics: Statistics = field(default_factory=Statistics)
    cache: Cache = field(default_factory=Cache)
    n_jobs: int = 1
    backend: str = "process"

    def to_dict(self) -> dict[str, Any]:
        return asdict(self)


# --- checks ---------------------------------------------------------------------------------------------------


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ConfigError(what)


def _mapping(x: Any, name: str) -> dict:
    _need(isinstance(x, dict), f"{name}: a mapping is needed")
    return x


def _texts(x: Any, name: str, allowed: tuple | None = None, least: int = 0) -> tuple[str, ...]:
    _need(isinstance(x, (list, tuple)) and all(isinstance(v, str) and v for v in x), f"{name}: a list of texts is needed")
    _need(len(x) >= least, f"{name}: at least {least} entries are needed")
    wrong = [v for v in x if allowed is not None and v not in allowed]
    _need(not wrong, f"{name}: {wrong} not among {allowed}")
    return tuple(x)


def _text(x: Any, name: str) -> str:
    _need(isinstance(x, str) and bool(x), f"{name}: a text is needed")
    return x


def _one_of(x: Any, name: str, allowed: tuple) -> Any:
    _need(x in allowed, f"{name}: {x!r} not among {allowed}")
    return x


def method_variants(x: Any, name: str = "analysis.method_variant") -> tuple[str, ...]:
    """One variant or a list of them."""
    return _texts((x,) if isinstance(x, str) else x, name, VARIANTS, 1)


def _families(raw: Any) -> dict[str, Family]:
    out = {}
    for name, g in _mapping(raw, "groups").items():
        g = _mapping(g, f"groups.{name}")
        types = _texts(g.get("config_types", ()), f"groups.{name}.config_types", least=1)
        out[name] = Family(name, frozenset(types), _text(g.get("label", name), f"groups.{name}.label"))
    _need(bool(out), "groups: at least one is needed")
    return out


def _comparisons(raw: Any, families: dict[str, Family]) -> tuple[Comparison, ...]:
    _need(isinstance(raw, list) and bool(raw), "comparisons: at least one is needed, as a list")
    out = []
    for k, c in enumerate(raw):
        at = f"comparisons[{k}]"
        c = _mapping(c, at)
        sides = [c.get(f"group_{s}") for s in "ab"]
        for s, g in zip("ab", sides, strict=True):
            _need(g in families, f"{at}.group_{s}: no group {g!r}")
        out.append(Comparison(_text(c.get("name"), f"{at}.name"), families[sides[0]], families[sides[1]], _one_of(c.get("expected_direction"), f"{at}.expected_direction", DIRECTIONS)))
    return tuple(out)


def _timeout(x: Any) -> float | None:
    if x is None:
        return None
    name = "metafeatures.pymfe_per_feature_timeout_s"
    _need(not isinstance(x, bool), f"{name}: a positive number is needed")
    try:
        x = float(x)
    except (TypeError, ValueError):
        raise ConfigError(f"{name}: a positive number is needed") from None
    _need(math.isfinite(x) and x > 0, f"{name}: a positive number is needed")
    return x


def parse_config(raw: dict[str, Any]) -> Config:
    raw = _mapping(raw, "config")
    _need("version" in raw, "version: needed")
    families = _families(raw.get("groups"))
    section = lambda name: _mapping(raw.get(name) or {}, name)
    a, m, s, c, p = (section(x) for x in ("analysis", "metafeatures", "statistics", "cache", "parallelism"))
    selection = a.get("selection_error_column", "metric_error_val")
    some = lambda key, default: _texts(m[key] if m.get(key) is not None else list(default), f"metafeatures.{key}")
    fdr = s.get("fdr_method", "bh")
    stages = _mapping(c.get("stages") or {}, "cache.stages")
    return Config(
        version=int(raw["version"]),
        families=families,
        comparisons=_comparisons(raw.get("comparisons"), families),
        analysis=Analysis(
            unit=_one_of(a.get("unit", "dataset"), "analysis.unit", UNITS),
            error_column=_text(a.get("error_column", "metric_error"), "analysis.error_column"),
            selection_error_column=None if selection is None else _text(selection, "analysis.selection_error_column"),
            method_variant=method_variants(a.get("method_variant", "tuned")),
            exclude_methods_containing=_texts(a.get("exclude_methods_containing", ()), "analysis.exclude_methods_containing"),
            exclude_problem_types=_texts(a.get("exclude_problem_types", ()), "analysis.exclude_problem_types", PROBLEM_TYPES),
        ),
        descriptors=Descriptors(
            feature_sets=some("feature_sets", Descriptors.feature_sets),
            external_groups=some("pymfe_groups", Descriptors.external_groups),
            external_summary=some("pymfe_summary", Descriptors.external_summary),
            external_timeout_s=_timeout(m.get("pymfe_per_feature_timeout_s")),
            retry_failed=bool(m.get("retry_failed_pymfe", False)),
            trace=bool(m.get("trace", False)),
            irregularity_components=some("irregularity_components", COMPONENTS),
        ),
        statistics=Statistics(
            correlation_method=_one_of(s.get("correlation_method", "spearman"), "statistics.correlation_method", ("spearman", "pearson")),
            alpha=float(s.get("alpha", 0.05)),
            fdr_method=_one_of(fdr, "statistics.fdr_method", (None, "bh", "holm")),
            confidence_interval=bool(s.get("confidence_interval", True)),
            ci_bootstrap_samples=int(s.get("ci_bootstrap_samples", 10_000)),
            ci_confidence_level=float(s.get("ci_confidence_level", 0.95)),
            multivariate=bool(s.get("multivariate", False)),
            multivariate_method=_one_of(s.get("multivariate_method", "ols"), "statistics.multivariate_method", ("ols", "ridge")),
        ),
        cache=Cache(bool(c.get("enabled", True)), str(c.get("directory", Cache.directory)), frozenset(x for x in sorted(Cache.stages) if bool(stages.get(x, True)))),
        n_jobs=int(p.get("n_jobs", 1)),
        backend=_one_of(str(p.get("backend", "process")), "parallelism.backend", BACKENDS),
    )


def load_config(path: str | Path) -> Config:
    """Read a YAML file; a relative cache folder belongs to the project that holds the file (the parent of ``configs``)."""
    import yaml

    path = Path(path).expanduser().resolve()
    raw = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    out = parse_config(raw)
    if "://" in out.cache.directory or Path(out.cache.directory).is_absolute():
        return out
    root = path.parent.parent if path.parent.name == "configs" else path.parent
    return replace(out, cache=replace(out.cache, directory=str((root / out.cache.directory).resolve())))
