"""Settings of a study and of its experiments, checked when they are made."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path
from typing import ClassVar

from weftline.operators.pooling import METHODS
from weftline.plans.catalog import expand_environment, strict

CONDITIONS = ("original", "masked", "removed")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Group:
    directory: str
    label_name: str
    label_id: int


@dataclass(frozen=True)
class Study:
    raw_root: str
    prepared_root: str
    private_root: str
    groups: tuple[dict, ...]
    keywords: tuple[str, ...] = ()
    keyword_mask: str = "[MASK]"
    maximum_posts: int = 64
    minimum_posts: int = 1
    folds: int = 5
    validation_fraction: float = 0.125
    threshold: float = 0.5

    def __post_init__(self) -> None:
        groups = tuple(g if isinstance(g, Group) else strict(Group, g) for g in self.groups)
        object.__setattr__(self, "groups", groups)
        object.__setattr__(self, "keywords", tuple(dict.fromkeys(self.keywords)))
        _need(len(groups) == 2 and len({g.directory for g in groups}) == 2 and {g.label_id for g in groups} == {0, 1}, "a study has two groups with directories and labels of their own")
        roots = [Path(r) for r in (self.raw_root, self.prepared_root, self.private_root)]
        _need(not any(a == b or a in b.parents for a in roots for b in roots if a is not b), "the three roots must not lie in each other")
        _need(self.maximum_posts >= 1 and self.minimum_posts >= 1 and self.folds >= 2, "counts are out of range")
        _need(0 < self.validation_fraction < 1 and 0 <= self.threshold <= 1, "fractions are out of range")

    @property
    def labels(self) -> dict[str, tuple[str, int]]:
        return {g.directory: (g.label_name, g.label_id) for g in self.groups}


@dataclass(frozen=True)
class LinearExperiment:
    solver: str = "svm"
    c: float = 1.0
    condition: str = "removed"
    seeds: tuple[int, ...] = (58, 59, 60, 61, 62, 63, 64, 65)
    pooling: str | None = None
    dims: int | None = None
    largest_gram: int = 2
    minimum_df: int = 2
    distributed: bool = False  # fit by sums over all rows; for cohorts of which a fold's training set is too large for one group

    def __post_init__(self) -> None:
        _need(self.solver in ("svm", "logistic") and self.c > 0, "an unknown solver or a penalty that isn't positive")
        _need(self.condition in CONDITIONS, f"conditions are {', '.join(CONDITIONS)}")
        _need(len(set(self.seeds)) == len(self.seeds) >= 2, "at least two distinct seeds")
        _need(self.pooling is None or self.pooling in METHODS, f"pooling is one of {', '.join(METHODS)}")
        _need((self.dims or 1) >= 1 and self.largest_gram >= 1 and self.minimum_df >= 1, "counts are out of range")


@dataclass(frozen=True)
class Benchmark:
    """A controlled comparison: one cohort, the same folds for all models."""

    strictly_more_posts_than: int = 20
    seeds: tuple[int, ...] = (58, 59, 60, 61, 62, 63, 64, 65)
    folds: int = 5
    reference: str = "full"
    primary_metric: str = "f1"
    EIGHT: ClassVar[int] = 8

    def __post_init__(self) -> None:
        _need(len(set(self.seeds)) == self.EIGHT and self.folds == 5, "the controlled benchmark has eight seeds and five folds")
        _need(self.strictly_more_posts_than >= 0, "the cohort rule is out of range")


def load(kind: type, path: str):
    """A settings object from a JSON file, `${NAME}` filled in from the environment."""
    return strict(kind, expand_environment(json.loads(Path(path).read_text(encoding="utf-8"))))
