"""User functions over rows and batches.

`batch_infer` applies a caller-supplied `list[str] -> list[str]` function to a column in Arrow
batches, loaded once per task. `map_batches` and `map_rows` apply any function to whole batches or
rows, with a declared output schema: columns may be dropped or made, and rows may become none or several.

The model itself is outside this library; predictions then flow through the
same column post-processors (T13/T16/T20) and metrics as any prediction table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def batch_infer(df: DataFrame, input_col: str, factory: Callable[[], Callable[[list[str]], list[str]]],
                output_col: str = "prediction", batch_size: int = 32) -> DataFrame:
    """Append `output_col`: `factory()` is called once per task to build the predictor,
    which then sees lists of up to `batch_size` inputs. A batch that raises is
    retried row by row; a row that still fails gets an empty prediction."""
    schema = T.StructType(df.schema.fields + [T.StructField(output_col, T.StringType())])

    def run(batches):
        predict = factory()
        for pdf in batches:
            outs: list[str] = []
            inputs = pdf[input_col].fillna("").astype(str).tolist()
            for i in range(0, len(inputs), batch_size):
                chunk = inputs[i:i + batch_size]
                try:
                    got = list(predict(chunk))
                    if len(got) != len(chunk):
                        raise ValueError("predictor returned a different number of outputs")
                except Exception:
                    got = []
                    for x in chunk:
                        try:
                            got.append(str(predict([x])[0]))
                        except Exception:
                            got.append("")
                outs.extend("" if g is None else str(g) for g in got)
            pdf[output_col] = pd.Series(outs, index=pdf.index, dtype=object)
            yield pdf

    return df.mapInPandas(run, schema)


def lowercase_gloss_model() -> Callable[[list[str]], list[str]]:
    """A stand-in predictor used in tests and the registered query: gloss -> lower-cased text."""
    return lambda xs: [x.lower() for x in xs]


def _schema(df: DataFrame, schema) -> tuple[T.StructType, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    struct = schema if isinstance(schema, T.StructType) else df.sparkSession.createDataFrame([], schema).schema
    return struct, to_arrow_schema(struct)


def _table(columns: dict, arrow: pa.Schema) -> pa.RecordBatch:
    missing = [n for n in arrow.names if n not in columns]
    if missing:
        raise ValueError(f"the function returned no column {missing}")
    sizes = {n: len(columns[n]) for n in arrow.names}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"the function returned column lengths {sizes}")
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)


def map_batches(df: DataFrame, factory: Callable[[], Callable[[dict], dict]], schema, batch_rows: int = 1000) -> DataFrame:
    """`factory()` is called once per task; its function gets dicts of column -> list of up to `batch_rows` values and
    returns such a dict for the columns of `schema`, of any one length. Other columns are dropped. An error, a
    missing column or unequal lengths end the job with that message: no row is left out in silence."""
    struct, arrow = _schema(df, schema)

    def run(batches):
        apply = factory()
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                yield _table(apply(batch.slice(at, batch_rows).to_pydict()), arrow)
    return df.mapInArrow(run, struct)


def map_rows(df: DataFrame, factory: Callable[[], Callable[[dict], dict | list[dict]]], schema, error_col: str | None = None) -> DataFrame:
    """U1 per row: the function gets a dict and returns one, or a list of them. With `error_col` a row that fails gives one row of
    nulls and the error's text in that column; without it the job ends."""
    struct, arrow = _schema(df, schema)
    if error_col:
        struct = T.StructType([*struct.fields, T.StructField(error_col, T.StringType())])
        arrow = arrow.append(pa.field(error_col, pa.string()))
    names = arrow.names

    def run(batches):
        apply = factory()
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                try:
                    got = apply(row)
                except Exception as e:
                    if not error_col:
                        raise
                    got = {error_col: f"{type(e).__name__}: {e}"}
                rows.extend([got] if isinstance(got, dict) else got)
            yield _table({n: [r.get(n) for r in rows] for n in names}, arrow)
    return df.mapInArrow(run, struct)
