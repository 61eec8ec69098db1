"""Recursive queries by iteration: the fixpoint of a term over the rows that the last round found."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tessera.errors import ResourceLimit
from tessera.store.shared import shared_dir

MAX_ROUNDS, MAX_ROWS = 1000, 1_000_000
#: Rounds that one job makes with UNION.
TOGETHER = 4


def fixpoint(seed: DataFrame, term: Callable[[DataFrame], DataFrame], distinct: bool = True, max_rounds: int = MAX_ROUNDS, max_rows: int | None = None, linear: bool = False) -> DataFrame:
    """WITH RECURSIVE seed UNION [ALL] term.

    The term sees only the rows of the previous round. With UNION (distinct) a row already found, NULLs being equal,
    is not found again, so cycles end. Each job's rows are written to the shared folder and all of them read as one table:
    plans stay small and a lost executor loses nothing. Rounds beyond the limit, and rows beyond one if it is given,
    raise ResourceLimit. linear: each row of the previous round adds its rows for itself (no grouping, sorting or negation
    of the rounds' rows), as the dialect demands, and the term may be applied to its own result; then one job makes several rounds of UNION.
    """
    spark = seed.sparkSession
    base = f"{shared_dir(spark)}/recursion-{uuid.uuid4().hex}"
    columns, types, paths = seed.columns, [f.dataType for f in seed.schema], []

    def stored(df: DataFrame) -> int:
        seen = Observation()
        paths.append(f"{base}/{len(paths)}")
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(paths[-1])
        return seen.get["n"]

    def typed(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").cast(t).alias(n) for c, t, n in zip(df.columns, types, columns, strict=True)])

    read = lambda *which: spark.read.schema(seed.schema).parquet(*which)
    total = stored(seed.distinct() if distinct else seed)
    work, rounds = read(paths[0]), 0
    while True:
        if max_rows is not None and total > max_rows:
            raise ResourceLimit(f"a recursive query found more than {max_rows} rows")
        if rounds > max_rounds:
            raise ResourceLimit(f"a recursive query ran for more than {max_rounds} rounds")
        if not distinct:
            found, rounds = typed(term(work)), rounds + 1
        else:
            # The last round's rows go on; those of the rounds before have been followed already.
            steps = [work]
            for _ in range(TOGETHER if linear else 1):
                steps.append(typed(term(steps[-1])).distinct())
            rounds += len(steps) - 1
            marked = reduce(lambda a, b: a.unionAll(b), (s.withColumn("_last", F.lit(s is steps[-1])) for s in steps[1:]))
            new, known = marked.groupBy(*columns).agg(F.max("_last").alias("_last")).alias("n"), read(*paths).alias("k")
            same = reduce(lambda a, b: a & b, (F.col(f"n.`{c}`").eqNullSafe(F.col(f"k.`{c}`")) for c in columns))
            found = new.join(known, same, "left_anti")
        count = stored(found)
        work = spark.read.schema(found.schema).parquet(paths[-1]).filter("_last").drop("_last") if distinct else read(paths[-1])
        if not count:
            return read(*paths)
        total += count
