"""The given tables made odd: empty ones, and ones with nulls everywhere, repeated rows and extra columns."""

import glob
import os
import random

import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq

from tests.conftest import SF

CLASHING = ("h", "kin", "key", "grp", "doc", "pos", "n", "id", "kind2", "rank", "run", "step", "place", "bucket", "_row", "known", "value2")


def empty(folder: str) -> str:
    for f in glob.glob(f"{SF}/*.parquet"):
        pq.write_table(pq.read_table(f).slice(0, 0), os.path.join(folder, os.path.basename(f)))
    return folder


def odd(folder: str, seed: int = 7) -> str:
    """Each value is null one time in six, each row stands twice one time in five; columns with clashing names are added."""
    rnd = random.Random(seed)
    for f in sorted(glob.glob(f"{SF}/*.parquet")):
        t = pq.read_table(f)
        keep = [i for i in range(min(t.num_rows, 400)) for _ in range(2 if rnd.random() < 0.2 else 1)]
        t = t.take(pa.array(keep, pa.int64()))
        for i, name in enumerate(t.column_names):
            hide = pa.array([rnd.random() < 1 / 6 for _ in range(t.num_rows)])
            t = t.set_column(i, t.schema.field(i), pa.compute.if_else(hide, pa.scalar(None, t.schema.field(i).type), t[name]))
        for c in CLASHING:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["x"] * t.num_rows))
        pq.write_table(t, os.path.join(folder, os.path.basename(f)))
    return folder
