"""Running rendered commands as a distributed stage."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_argv(argv: list[str], timeout: float | None = None) -> tuple[int, str]:
    """Exit code and error text of a program run without a shell; 127 if it is not there, 124 after ``timeout``."""
    try:
        done = subprocess.run(argv, stdout=subprocess.DEVNULL, stderr=subprocess.PIPE, timeout=timeout, check=False)
    except FileNotFoundError as e:
        return 127, str(e)
    except subprocess.TimeoutExpired as e:
        return 124, str(e)
    return done.returncode, done.stderr.decode(errors="replace")


def run_commands(df: DataFrame, key: str, argv: str, runner: Callable[[list[str]], tuple[int, str]] = run_argv) -> DataFrame:
    """(key, exit_code, stderr) of each row's command; a null command is not run and has a null exit code.

    A task that Spark repeats runs its commands again, so they must bear that.
    """
    kind = df.schema[key].dataType.simpleString()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [(None, None) if a is None else runner(a) for a in batch.column(1).to_pylist()]
            codes, errors = zip(*done) if done else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.int32()), pa.array(errors, pa.string())], names=[key, "exit_code", "stderr"])

    return df.select(key, argv).mapInArrow(of, f"`{key}` {kind}, exit_code int, stderr string")


def require_success(status: DataFrame) -> DataFrame:
    """The status rows, failing the job at the first command that did not end with 0."""
    message = F.concat(F.lit("command failed with "), F.col("exit_code").cast("string"), F.lit(": "), F.coalesce("stderr", F.lit("")))
    return status.withColumn("exit_code", F.when(F.coalesce(F.col("exit_code"), F.lit(0)) == 0, F.col("exit_code")).otherwise(F.raise_error(message).cast("int")))
