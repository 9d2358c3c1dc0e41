"""Jobs: a fit over packed chunks that can be taken up again, with what it keeps on the way."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import Tree
from ..operators import decode
from ..sources import tables
from . import em


def infer(
    packed: DataFrame, chunks: DataFrame, mode: str, tree: Tree, avail: np.ndarray, k: int, out: str, run_id: str,
    resume: str | None = None, save_q: int = 1, iterations: int = 50, start: dict | None = None, **how,
) -> tuple[dict[str, np.ndarray], DataFrame | None]:
    """Fits packed chunks and keeps in the folder out: params, the parameters of each iteration, and q, posteriors by level
    (tables.save_posteriors: 0 none, 1 of the last iteration, 2 of every one, 3 also the last one's by chromosome, which is
    returned). resume names an earlier run in the same folder whose last parameters are the start, in place of those given. packed should be kept;
    separate thetas take up a common one."""
    spark = packed.sparkSession
    branches = len(tree.branch()) if how.get("separate_theta") else None
    start = tables.load_params(spark, f"{out}/params", resume, children=branches) if resume else start

    def keep(n: int, params: dict, last: bool) -> DataFrame | None:
        if save_q >= 2 or (save_q and last):
            q = decode.stitch(em.posteriors(packed, mode, params, tree, avail), chunks)
            return tables.save_posteriors(q, f"{out}/q", save_q, n, last)
        return None

    def on_step(n: int, params: dict, value: float) -> None:
        tables.save_params(spark, params, f"{out}/params", run_id, n)
        spark.createDataFrame([(run_id, n, float(value), "free_energy")], "run_id string, iter int, objective double, kind string").coalesce(1).write.mode("append").parquet(f"{out}/objectives")
        if save_q >= 2:
            keep(n, params, False)

    params, path = em.fit(packed, mode, tree, avail, k, iterations=iterations, start=start, on_step=on_step, **how)
    tables.save_params(spark, params, f"{out}/params", run_id, len(path))
    return params, keep(len(path), params, True)


def progress(spark, out: str) -> DataFrame:
    """The objectives of all runs in a folder, as decode.trajectory gives them."""
    return decode.trajectory(spark.read.parquet(f"{out}/objectives").filter(F.col("objective").isNotNull()))
