"""Extension points: raters and page sources registered by name."""

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Rater = Callable[[DataFrame], DataFrame]
RATERS: dict[str, Rater] = {}
RATING = T.StructType(
    [
        T.StructField("rate_provider", T.StringType()),
        T.StructField("rated_model", T.StringType()),
        T.StructField("rate_num", T.IntegerType()),
        T.StructField("rate_reason", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)
INPUTS = ("title", "location", "tags", "description", "enrich_summary")


def register_rater(name: str, rater: Rater) -> None:
    """A rater adds the five rating columns to job rows; the same name replaces."""
    RATERS[name] = rater


def rater(name: str) -> Rater:
    return RATERS[name]


def pandas_rater(score) -> Rater:
    """A rater from a function over pandas batches of the five input columns.

    Only the inputs travel to Python, as one struct column, so the other columns
    stay in the JVM and earlier filters stay below the Python step.
    """

    @F.pandas_udf(RATING)
    def rated(title: pd.Series, location: pd.Series, description: pd.Series, summary: pd.Series) -> pd.DataFrame:
        rows = pd.DataFrame({"title": title, "location": location, "description": description, "enrich_summary": summary}).fillna("")
        return score(rows)[[f.name for f in RATING.fields]]

    def run(df: DataFrame) -> DataFrame:
        out = df.withColumn("_r", rated("title", "location", "description", "enrich_summary"))
        return out.withColumns({f.name: F.col(f"_r.{f.name}") for f in RATING.fields}).drop("_r")

    return run


@dataclass(frozen=True)
class Source:
    """A page source: how its addresses look, and the selectors of its pages."""

    id: str
    name: str
    match: tuple[str, ...]
    list_rules: dict = field(default_factory=dict)
    detail_rules: dict = field(default_factory=dict)

    def errors(self) -> list[str]:
        missing = [n for n in ("id", "name", "match", "list_rules", "detail_rules") if not getattr(self, n)]
        return [f"missing {n}" for n in missing]


class SourceRegistry:
    """Sources in the order they were registered; the same id replaces in place."""

    def __init__(self, *sources: Source):
        self._sources: list[Source] = []
        for source in sources:
            self.register(source)

    def register(self, source: Source) -> None:
        problems = source.errors()
        if problems:
            raise ValueError("; ".join(problems))
        ids = [s.id for s in self._sources]
        if source.id in ids:
            self._sources[ids.index(source.id)] = source
        else:
            self._sources.append(source)

    def __iter__(self):
        return iter(self._sources)

    def get(self, source_id: str) -> Source:
        return next(s for s in self._sources if s.id == source_id)
