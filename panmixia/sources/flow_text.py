"""Flow fields as text: two lines of (least, largest, number), then the two matrices row by row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import SparkSession

from panmixia.operators.flow import C_N, M_N, FlowField


def write_flow_field(spark: SparkSession, path: str, flow: FlowField) -> None:
    """One text file of 104 lines, written through Spark so that any of its file systems will do."""
    lines = [f"1e-05 100.0 {M_N}", f"0.01 1.0 {C_N}"] + [" ".join(f"{x:.10f}" for x in row) for m in (flow.u, flow.v) for row in m]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_flow_field(spark: SparkSession, path: str) -> FlowField:
    """Fields of another grid are refused."""
    parts = " ".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()).split()
    if (int(parts[2]), int(parts[5])) != (M_N, C_N):
        raise ValueError(f"the grid must be {M_N} by {C_N}")
    values = np.array(parts[6:], float)
    return FlowField(values[: M_N * C_N].reshape(M_N, C_N), values[M_N * C_N :].reshape(M_N, C_N))
