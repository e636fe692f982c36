"""Common ground of the fitted operators: state kept as JSON in an ML parameter.

The state is part of the stage's metadata, so a saved pipeline holds everything that was
learned and needs no side files.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

__all__ = ["JsonEstimator", "JsonModel", "JsonTransformer", "DataFrame", "keyword_only"]


class _WithOptions(Params, DefaultParamsReadable, DefaultParamsWritable):
    """Options held in one JSON parameter; subclasses list their defaults."""

    DEFAULTS: dict[str, Any] = {}

    def __init__(self, **options):
        super().__init__()
        self.options = Param(self, "options", "settings as JSON", TypeConverters.toString)
        unknown = set(options) - set(self.DEFAULTS)
        if unknown:
            raise TypeError(f"{type(self).__name__}: unknown options {sorted(unknown)}")
        self._set(options=json.dumps({**self.DEFAULTS, **options}))

    def opt(self, name: str) -> Any:
        return json.loads(self.getOrDefault(self.options))[name]


class JsonTransformer(_WithOptions, Transformer):
    """A transformer that needs no fitting."""


class JsonEstimator(_WithOptions, Estimator):
    """An estimator whose options carry over to its model."""


class JsonModel(_WithOptions, Model):
    """A fitted stage: the estimator's options plus what it learned."""

    def __init__(self, learned: dict | None = None, **options):
        super().__init__(**options)
        self.learned = Param(self, "learned", "fitted state as JSON", TypeConverters.toString)
        self._set(learned=json.dumps(learned or {}))

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.learned))

    @classmethod
    def from_estimator(cls, estimator: JsonEstimator, learned: dict) -> JsonModel:
        return cls(learned, **json.loads(estimator.getOrDefault(estimator.options)))
