"""Pipelines: a fold of stages over a DataFrame, with sources first and sinks last."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.scope import Unsupported
from tessera.operators.collation import Collation
from tessera.operators.stages import STAGES, literal_rows

SINKS = ("$out", "$merge")


@dataclass
class Context:
    """What stages may ask for: other collections, sources that need no collection, and the options of the call."""

    spark: SparkSession
    collection: Callable[[str], DataFrame]
    collation: Collation | None = None
    text_fields: tuple[str, ...] | None = None
    sources: dict[str, Callable[[Any], DataFrame]] = field(default_factory=dict)
    #: The stages behind the one that runs.
    following: list[dict] = field(default_factory=list)

    def run(self, df: DataFrame | None, pipeline: list[dict]) -> DataFrame:
        return run_stages(df, pipeline, self)


def stage_of(document: dict) -> tuple[str, Any]:
    if len(document) != 1:
        raise ValueError("a stage has one field")
    return next(iter(document.items()))


def normalized(pipeline: tuple | list) -> list[dict]:
    """The stages of a call that gives them as a list or one by one."""
    stages = list(pipeline[0]) if len(pipeline) == 1 and isinstance(pipeline[0], list | tuple) else list(pipeline)
    if not all(isinstance(s, dict) for s in stages):
        raise TypeError("stages are documents")
    return stages


def merged_matches(pipeline: list[dict]) -> list[dict]:
    """Neighbouring matches become one."""
    out: list[dict] = []
    for document in pipeline:
        name, spec = stage_of(document)
        if name == "$match" and out and "$match" in out[-1] and not _ordered(spec) and not _ordered(out[-1]["$match"]):
            out[-1] = {"$match": {"$and": [out[-1]["$match"], spec]}}
        else:
            out.append(document)
    return out


def _ordered(query: dict) -> bool:
    return any(isinstance(v, dict) and ("$near" in v or "$nearSphere" in v) for v in query.values())


def split_sink(pipeline: list[dict]) -> tuple[list[dict], tuple[str, Any] | None]:
    if any(stage_of(s)[0] in SINKS for s in pipeline[:-1]):
        raise ValueError("$out and $merge stand last")
    if pipeline and stage_of(pipeline[-1])[0] in SINKS:
        return pipeline[:-1], stage_of(pipeline[-1])
    return pipeline, None


def run_stages(df: DataFrame | None, pipeline: list[dict], ctx: Context) -> DataFrame:
    stages = merged_matches(pipeline)
    for i, document in enumerate(stages):
        name, spec = stage_of(document)
        if i == 0 and name in ctx.sources:
            df = ctx.sources[name](spec)
        elif i == 0 and name == "$documents":
            df = literal_rows(ctx.spark, spec)
        elif i == 0 and name == "$sql":
            df = ctx.spark.sql(spec["statement"] if isinstance(spec, dict) else spec)
        elif name not in STAGES:
            raise Unsupported(f"stage {name}" + (" after the first place" if name in ctx.sources else ""))
        else:
            if df is None:
                raise ValueError(f"{name} needs a collection or a source before it")
            df = STAGES[name](df, spec, replace(ctx, following=stages[i + 1 :]))
    if df is None:
        raise ValueError("a pipeline without a collection starts with a source")
    return df


def aggregate(df: DataFrame, pipeline: list[dict], collections: dict[str, DataFrame] | None = None, collation: dict | None = None) -> DataFrame:
    """Run a pipeline over a DataFrame, with other collections by name."""
    others = {} if collections is None else collections
    ctx = Context(df.sparkSession, others.__getitem__, Collation.of(collation))
    stages, sink = split_sink(pipeline)
    if sink:
        raise Unsupported("sinks write to a database; use its collections")
    return run_stages(df, stages, ctx)
