"""The whole analysis as one lazy graph: results, gaps, descriptors, analysis table, associations."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Config, ConfigError
from ..operators.analysis import analysis_table
from ..operators.associations import associations, corrected, robust_associations
from ..operators.descriptors import basic, profiles
from ..operators.external import external, external_columns
from ..operators.features import predictors, preprocess, reduce_redundant
from ..operators.gaps import pairwise_gaps
from ..operators.irregularity import irregularity
from ..operators.redundancy import redundancy
from ..operators.sensitivity import sensitivity
from ..schemas import BASIC, IRREGULARITY, REDUNDANCY, SPLIT
from ..sources.metadata import problem_types_payload, without_problem_types
from ..sources.results import select_results
from ..sources.splits import SplitRows
from .store import Appended, Store, content_hash, stage_hash, with_identity

log = logging.getLogger("splitscope")
MOST_FAILURES = 32
FEATURE_SETS = ("basic", "redundancy", "irregularity", "pymfe")
SCHEMA_VERSIONS = {"basic": 1, "redundancy": 1, "irregularity": 1, "pymfe": 1}


def check_feature_sets(names) -> None:
    wrong = [n for n in names if n not in FEATURE_SETS]
    if wrong:
        raise ValueError(f"unknown feature sets {wrong}; there are {FEATURE_SETS}")


def set_columns(name: str, config: Config) -> dict[str, str]:
    """The columns of a feature set and their types."""
    d = config.descriptors
    fixed = {"basic": BASIC, "redundancy": REDUNDANCY, "irregularity": list(IRREGULARITY)}
    counts = {"n", "d", "n_num_features", "n_cat_features", "n_classes"}
    return {c: "long" if c in counts else "double" for c in (external_columns(d.external_groups, d.external_summary) if name == "pymfe" else fixed[name])}


def build_set(name: str, sr: SplitRows, config: Config, profile: DataFrame) -> DataFrame:
    """One feature set, one row per split."""
    d = config.descriptors
    build = {
        "basic": lambda: basic(sr, profile), "redundancy": lambda: redundancy(sr, profile), "irregularity": lambda: irregularity(sr, profile),
        "pymfe": lambda: external(sr, d.external_groups, d.external_summary, profile),
    }
    return build[name]().select(*SPLIT, *(F.col(f"`{c}`").cast(t).alias(c) for c, t in set_columns(name, config).items()))


def describe(sr: SplitRows, config: Config) -> DataFrame:
    """The configured descriptors, one row per split, as one lazy plan: an error in any set is an error of the whole."""
    check_feature_sets(config.descriptors.feature_sets)
    profile = profiles(sr)
    keys = sr.keys().drop("kind")
    return reduce(lambda a, b: a.join(b, SPLIT, "left"), (build_set(s, sr, config, profile) for s in config.descriptors.feature_sets), keys)


def describe_stored(sr: SplitRows, config: Config, store: Store, key: str) -> DataFrame:
    """The descriptors with ``failed_sets``, one stored row per split and feature set.

    Only splits without a stored row of the same identity (settings of the set, features, problem type) are computed; ``retry_failed`` also computes
    those whose set failed before.  Sets other than the irregularity are best effort: the splits at which one fails are found by halving
    (:func:`isolated`) and hold NULLs and the reason, all others are kept.  Rows are appended, the newest of an identity counts, so a broken run loses
    nothing.  The profile of all splits with work to do is written once and read by every set."""
    check_feature_sets(config.descriptors.feature_sets)
    d, spark = config.descriptors, store.spark
    keys = sr.keys()
    work = {}
    for name in d.feature_sets:
        columns = set_columns(name, config)
        settings = {"set": name, "schema": SCHEMA_VERSIONS[name], "features": sr.features, "external": [d.external_groups, d.external_summary] if name == "pymfe" else None}
        wanted = with_identity(keys, settings, "kind").drop("kind")
        table = store.table(2, f"splits_{name}", key)
        schema = ", ".join(["dataset string", "repeat int", "fold int", "identity string", "failure string", "attempt int", *(f"`{c}` {t}" for c, t in columns.items())])
        stored = newest(table.read(schema))
        held = stored.where("failure is null") if d.retry_failed else stored
        targets = wanted.join(held.select(*SPLIT, "identity"), [*SPLIT, "identity"], "left_anti")
        n = targets.count()
        log.info("feature set %s: %d splits to compute", name, n)
        work[name] = (columns, schema, table, wanted, targets if n else None)
    todo = [t.select(*SPLIT) for *_, t in work.values() if t is not None]
    profile = _shared_profile(sr.only(reduce(DataFrame.unionByName, todo).distinct()), store, key) if todo else None
    tables = []
    for name, (columns, schema, table, wanted, targets) in work.items():
        if targets is not None:
            _fill(name, sr, config, profile, targets, table, schema, columns)
        rows = newest(table.read(schema)).join(wanted, [*SPLIT, "identity"], "left_semi")
        tables.append(rows.select(*SPLIT, *(F.col(f"`{c}`") for c in columns), F.col("failure").alias(f"__failure_{name}")))
    out = reduce(lambda a, b: a.join(b, SPLIT, "left"), tables, keys.select(*SPLIT))
    failed = F.filter(F.array(*(F.struct(F.lit(s).alias("key"), F.col(f"__failure_{s}").alias("value")) for s in d.feature_sets)), lambda x: x["value"].isNotNull())
    return out.withColumn("failed_sets", F.to_json(F.map_from_entries(failed))).drop(*(f"__failure_{s}" for s in d.feature_sets))


def _shared_profile(sr: SplitRows, store: Store, key: str) -> DataFrame | None:
    """The written profile of these splits; None if it fails, then every attempt at a set makes its own."""
    try:
        return store.write(profiles(sr), 2, "profiles", key)
    except Exception as e:
        log.warning("profile of all splits failed: %s", _reason(e))
        return None


def _reason(e: Exception) -> str:
    return f"{type(e).__name__}: {str(e).splitlines()[0][:200] if str(e) else ''}"


def _fill(name: str, sr: SplitRows, config: Config, profile: DataFrame | None, targets: DataFrame, table: Appended, schema: str, columns: dict[str, str]) -> None:
    """Append the rows of the targets, with NULLs and the reason where the set fails."""

    def build(part: DataFrame) -> DataFrame:
        own = sr.only(part)
        known = profiles(own) if profile is None else profile.join(part.select(*SPLIT), SPLIT, "left_semi")
        return part.join(build_set(name, own, config, known), SPLIT, "left").withColumn("failure", F.lit(None).cast("string"))

    def save(rows: DataFrame) -> None:
        table.append(rows, schema)

    def give_up(part: DataFrame, e: Exception) -> None:
        log.warning("feature set %s failed: %s", name, _reason(e))
        table.append(part.withColumns({"failure": F.lit(_reason(e))} | {c: F.lit(None).cast(t) for c, t in columns.items()}), schema)

    if name == "irregularity":
        save(build(targets))
    else:
        isolated(targets, build, save, give_up)


def isolated(targets: DataFrame, build: Callable[[DataFrame], DataFrame], save: Callable[[DataFrame], None], give_up: Callable[[DataFrame, Exception], None], most: int = MOST_FAILURES) -> int:
    """``save`` what ``build`` makes of all targets but those at which Spark fails, which are given up; returns the number of attempts.

    A failing part is halved by the hash of its splits, so one bad split of n costs about 2 log2(n) attempts.  A ``build`` that fails, which runs nothing yet, and
    all parts that fail after ``most`` single splits did are given up whole: the fault is then not in the data of a split."""
    place = F.xxhash64(*SPLIT)
    todo, attempts, single = [(-(2**63), 2**63 - 1)], 0, 0
    while todo:
        low, high = todo.pop()
        part = targets.where((place >= low) & (place <= high))
        try:
            rows = build(part)
        except Exception as e:
            give_up(part, e)
            continue
        attempts += 1
        try:
            save(rows)
        except Exception as e:
            first, last = part.agg(F.min(place), F.max(place)).first()
            if first is None:  # no split is in it
                continue
            if first == last or single >= most:
                single += 1
                give_up(part, e)
            else:
                middle = (first + last) // 2  # between two of them, so either half has some
                todo += [(middle + 1, last), (first, middle)]
    return attempts


def newest(rows: DataFrame) -> DataFrame:
    """The last attempt of each split and identity."""
    last = F.row_number().over(Window.partitionBy(*SPLIT, "identity").orderBy(F.desc("attempt")))
    return rows.withColumn("__nth", last).where("__nth = 1").drop("__nth")


@dataclass
class Result:
    config_hash: str
    results: DataFrame
    gaps: DataFrame
    descriptors: DataFrame
    analysis: DataFrame
    associations: dict[str, DataFrame] = field(default_factory=dict)
    robust: dict[str, DataFrame] = field(default_factory=dict)
    sensitivity: dict[str, DataFrame] = field(default_factory=dict)


def run_analysis(config: Config, results: DataFrame, splits: SplitRows, metadata: DataFrame | None = None, store: Store | None = None, statistics: bool = False, repeats: int | None = None) -> Result:
    """Nothing runs before a table of the result is asked for, unless a store keeps the stages or statistics are wanted.

    With a store, raw results and gaps are kept whole under content hashes; descriptors are kept and repaired split by split and feature set by
    feature set.  Statistics settings take no part in the identity of earlier stages: changing them rebuilds nothing upstream."""
    a = config.analysis
    began = time.perf_counter()
    key = content_hash({"version": config.version})
    keep = lambda name: store is not None and config.cache.enabled and name in config.cache.stages

    def stage(number: int, name: str, h: str, build: Callable[[], DataFrame]) -> DataFrame:
        out = store.once(number, name, h, build) if keep(name) else build()
        log.info("stage %d %s (%s): ready after %.1f s", number, name, h, time.perf_counter() - began)
        return out

    scope = {"excluded": a.exclude_problem_types}
    if metadata is not None and a.exclude_problem_types:
        scope["types"] = [tuple(r) for r in problem_types_payload(metadata).collect()] if store is not None else None  # one row per dataset
        wanted = without_problem_types(results.select("dataset").distinct(), metadata, a.exclude_problem_types)
        splits = splits.within(without_problem_types(splits.rows.select("dataset").distinct(), metadata, a.exclude_problem_types))
    else:
        wanted = None
    raw_hash = stage_hash("raw_results", key, {"metrics": a.metrics, "variants": a.method_variant, "without": a.exclude_methods_containing, "scope": scope})
    rows = stage(1, "raw_results", raw_hash, lambda: select_results(results, a, wanted))
    described = describe_stored(splits, config, store, key) if keep("metafeatures") else describe(splits, config)
    log.info("stage 2 metafeatures: ready after %.1f s", time.perf_counter() - began)
    gap_hash = stage_hash("gaps", raw_hash, {"comparisons": config.comparisons, "errors": [a.error_column, a.selection], "folds": a.folds_per_repeat})
    gaps = stage(3, "gaps", gap_hash, lambda: pairwise_gaps(rows, config.comparisons, a.error_column, a.selection, a.folds_per_repeat))
    table = analysis_table(gaps, described.drop("failed_sets"), a.unit, config.descriptors.irregularity_components)
    out = Result(key, rows, gaps, described, table)
    if statistics and a.unit == "dataset":
        s = config.statistics
        if s.multivariate and s.multivariate_method != "ols":
            raise ConfigError(f"statistics.multivariate_method: {s.multivariate_method!r} is not available, only 'ols'")
        n = repeats or (s.ci_bootstrap_samples if s.confidence_interval else 0)
        for c in config.comparisons:
            one = table.where(F.col("comparison_name") == c.name)
            features = predictors(one)
            cleaned, _ = preprocess(one, features, c.name, ["dataset", "delta_norm"])
            kept = [f for f in cleaned.columns if f not in ("dataset", "delta_norm")]
            reduced, _ = reduce_redundant(cleaned, kept, c.name, ["dataset", "delta_norm"])
            found = corrected(associations(reduced, c.name, alpha=s.alpha, ci_alpha=1 - s.ci_confidence_level, method=s.correlation_method, repeats=max(1, n)), s.fdr_method, c.expected_direction)
            out.associations[c.name], out.robust[c.name] = found, robust_associations(found, c.name, s.alpha, q="p_adjusted")
            log.info("statistics of %s: planned after %.1f s", c.name, time.perf_counter() - began)
            if s.multivariate:
                out.sensitivity[c.name] = sensitivity(reduced, out.robust[c.name], c.name, controls_from=one)[0]
    return out
