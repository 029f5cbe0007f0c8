"""Batch inference with caller-supplied models."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# model: pa.Table of input rows -> dict of output columns, one value per row
Model = Callable[[pa.Table], dict]
Factory = Callable[[], Model]
NO_VALUE = "the model gave no value"


def _process_cache() -> dict:
    """Models of this worker process; kept on a module so that they outlive a task."""
    import sys
    import types

    return sys.modules.setdefault("_loaded_models", types.ModuleType("_loaded_models")).__dict__


def _score(model: Model, rows: pa.Table, names: list[str]) -> tuple[dict, list]:
    """Outputs and errors of a batch; a failing batch is retried row by row."""
    try:
        out = model(rows)
        values = {n: list(out[n]) for n in names}
        return values, [NO_VALUE if all(values[n][k] is None for n in names) else None for k in range(rows.num_rows)]
    except Exception:
        values, errors = {n: [] for n in names}, []
        for k in range(rows.num_rows):
            try:
                one = model(rows.slice(k, 1))
                picked = {n: list(one[n])[0] for n in names}
                error = NO_VALUE if all(v is None for v in picked.values()) else None
            except Exception as problem:  # a bad image never fails the job
                picked, error = dict.fromkeys(names), str(problem)
            for n in names:
                values[n].append(picked[n])
            errors.append(error)
        return values, errors


def infer_with_fallback(df: DataFrame, factories: list[tuple[str, Factory]], schema: str, id_col: str = "image_id") -> DataFrame:
    """Score rows with the first model variant that loads: ``id, outputs, variant, error``.

    A variant is loaded once per worker process, and goes when the process starts on another call.  When
    none loads every row carries the error; a row without any output value is an error too.
    """
    spark = df.sparkSession
    outputs = spark.createDataFrame([], schema).schema
    names = outputs.fieldNames()
    id_type = df.schema[id_col].dataType
    run = uuid.uuid4().hex
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StringType, StructField, StructType

    full = StructType([StructField(id_col, id_type), *outputs.fields,
                       StructField("variant", StringType()), StructField("error", StringType())])
    arrow = to_arrow_schema(full)

    def load():
        cache = _process_cache()
        if run not in cache:
            for old in [k for k in cache if not k.startswith("__")]:  # a worker holds the models of one call at most
                del cache[old]
            problems = []
            for variant, factory in factories:
                try:
                    cache[run] = (variant, factory(), None)
                    break
                except Exception as problem:
                    problems.append(f"{variant}: {problem}")
            else:
                cache[run] = (None, None, "; ".join(problems))
        return cache[run]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            variant, model, failure = load()
            if model is None:
                values, errors = {n: [None] * rows.num_rows for n in names}, [failure] * rows.num_rows
            else:
                values, errors = _score(model, rows, names)
            arrays = [rows[id_col].combine_chunks()]
            arrays += [pa.array(values[n], arrow.field(n).type) for n in names]
            arrays += [pa.array([variant] * rows.num_rows, pa.string()), pa.array(errors, pa.string())]
            yield from pa.Table.from_arrays(arrays, names=full.fieldNames()).to_batches()

    return df.mapInArrow(score, full)


def batch_infer(df: DataFrame, factory: Factory, schema: str, id_col: str = "image_id") -> DataFrame:
    """Score every row with one model: ``id, outputs, error``; a bad row becomes an error row."""
    return infer_with_fallback(df, [("model", factory)], schema, id_col).drop("variant")
