"""Preprocessing and selection as stages of `pyspark.ml` pipelines, with params and persistence.

Stages work on columns, not on vectors: `inputCols` are candidates, of which a stage takes those that are there, so that
a filter may drop some before it. Everything that a fit finds is a param of its model, so models are saved as others are.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.base import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import cells, learning
from .learning import moments


def _param(name: str, doc: str, convert=TypeConverters.identity) -> Param:
    return Param(Params._dummy(), name, doc, typeConverter=convert)


class _Stage(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Params by keyword, defaults by the class."""

    DEFAULTS: dict = {}

    def __init__(self, **params):
        super().__init__()
        self._setDefault(**self.DEFAULTS)
        self._set(**{k: v for k, v in params.items() if v is not None})

    def value(self, name: str):
        return self.getOrDefault(self.getParam(name))

    def there(self, df: DataFrame) -> list[str]:
        return [c for c in self.getInputCols() if c in df.columns]


class DroppedColumns(_Stage, Model):
    """Without the columns that a filter or a selection left out."""

    dropped = _param("dropped", "columns that go", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.value("dropped"))


class _Filter(_Stage, Estimator):
    def kept(self, df: DataFrame, cols: list[str]) -> list[str]:
        raise NotImplementedError

    def _fit(self, df: DataFrame) -> DroppedColumns:
        cols = self.there(df)
        kept = set(self.kept(df, cols)) if cols else set()
        return DroppedColumns(inputCols=self.getInputCols(), dropped=[c for c in cols if c not in kept])


class MissingRateFilter(_Filter):
    """M1: columns with a share of nulls below the threshold stay, or the first."""

    threshold = _param("threshold", "share of nulls", TypeConverters.toFloat)
    DEFAULTS = {"threshold": 0.6}

    def kept(self, df, cols):
        return learning.missing_rate_filter(df, cols, self.value("threshold"))


class VarianceFilter(_Filter):
    """M3: columns with more than the least population variance stay."""

    least = _param("least", "least variance", TypeConverters.toFloat)
    DEFAULTS = {"least": 1e-8}

    def kept(self, df, cols):
        return learning.variance_filter(df, cols, self.value("least"))


class CorrelationFilter(_Filter):
    """M4: of columns that correlate above the threshold the first stays; columns are without nulls."""

    threshold = _param("threshold", "absolute correlation", TypeConverters.toFloat)
    DEFAULTS = {"threshold": 0.95}

    def kept(self, df, cols):
        return learning.correlation_filter(df, cols, self.value("threshold"))


class Selector(_Filter, HasLabelCol):
    """The columns of a strategy of the grid of cells (k_best, information, mrmr, l1, stability, consensus).

    choice names one of the strategy's grid, as `k=10`; keyCol tells rows apart where subsamples are drawn.
    """

    strategy = _param("strategy", "name of the strategy", TypeConverters.toString)
    choice = _param("choice", "one of its grid", TypeConverters.toString)
    keyCol = _param("keyCol", "column that tells rows apart", TypeConverters.toString)
    DEFAULTS = {"strategy": "consensus", "choice": ""}

    def kept(self, df, cols):
        label = self.getLabelCol()
        key = self.value("keyCol") if self.isDefined(self.getParam("keyCol")) else label
        return cells.selected(df, key, cols, label, self.value("strategy"), self.value("choice"))


class FilledColumns(_Stage, Model):
    """Nulls and NaN become the values of the fit."""

    values = _param("values", "value of each column", TypeConverters.toListFloat)
    columns = _param("columns", "columns of the values", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        held = {c: v for c, v in zip(self.value("columns"), self.value("values"), strict=True) if c in df.columns}
        return df.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(v)) for c, v in held.items()})


class MedianImputer(_Stage, Estimator):
    """M2: nulls become the exact median of the rows of the fit, or 0 where there is none."""

    def _fit(self, df: DataFrame) -> FilledColumns:
        cols = self.there(df)
        found = df.agg(*(F.percentile(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.5)).alias(c) for c in cols)).first() if cols else {}
        return FilledColumns(inputCols=self.getInputCols(), columns=cols, values=[float(found[c] or 0.0) for c in cols])


class ScaledColumns(_Stage, Model):
    means = _param("means", "mean of each column", TypeConverters.toListFloat)
    scales = _param("scales", "deviation of each column", TypeConverters.toListFloat)
    columns = _param("columns", "columns of both", TypeConverters.toListString)

    def _transform(self, df: DataFrame) -> DataFrame:
        held = zip(self.value("columns"), self.value("means"), self.value("scales"), strict=True)
        return df.withColumns({c: (F.col(c) - m) / s for c, m, s in held if c in df.columns})


class Standardizer(_Stage, Estimator):
    """M5: less the mean, over the population deviation (1 where it is 0)."""

    def _fit(self, df: DataFrame) -> ScaledColumns:
        cols = self.there(df)
        _, mean, cov = moments(df, cols)
        scale = np.sqrt(np.clip(np.diag(cov), 0, None))
        return ScaledColumns(inputCols=self.getInputCols(), columns=cols, means=mean.tolist(), scales=np.where(scale > 0, scale, 1.0).tolist())


class ComponentColumns(_Stage, Model):
    """Columns of each block as sums of its standardized ones."""

    blocks = _param("blocks", "name, columns, means, scales and loadings of each block")

    def _transform(self, df: DataFrame) -> DataFrame:
        made, gone = {}, []
        for name, cols, means, scales, loadings in self.value("blocks"):
            z = F.array(*((F.col(c) - m) / s for c, m, s in zip(cols, means, scales, strict=True)))
            made |= {f"{name}_pc{j}": F.aggregate(F.zip_with(z, F.array(*map(F.lit, w)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x) for j, w in enumerate(loadings)}
            gone += cols
        return df.withColumns(made).drop(*gone)


class BlockPca(_Stage, Estimator):
    """Each block of more than two columns as the components that keep a share of its variance, two at least.

    blocks maps names to columns; columns are without nulls.
    """

    blocks = _param("blocks", "columns of each block")
    variance = _param("variance", "share of the variance", TypeConverters.toFloat)
    DEFAULTS = {"variance": 0.8, "inputCols": []}

    def _fit(self, df: DataFrame) -> ComponentColumns:
        out = []
        for name, block in self.value("blocks").items():
            cols = [c for c in block if c in df.columns]
            if len(cols) <= 2:
                continue
            _, mean, cov = moments(df, cols)
            scale = np.sqrt(np.clip(np.diag(cov), 0, None))
            scale = np.where(scale > 0, scale, 1.0)
            values, vectors = np.linalg.eigh(cov / scale[:, None] / scale[None, :])
            values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
            vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(cols))] < 0, -1, 1)
            k = min(max(int(np.searchsorted(np.cumsum(values) / (values.sum() or 1), self.value("variance"))) + 1, 2), len(cols))
            out.append([name, cols, mean.tolist(), scale.tolist(), vectors[:, :k].T.tolist()])
        return ComponentColumns(inputCols=[], blocks=out)
