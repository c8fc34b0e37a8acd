"""Places of rows in a global order, without a task that sees them all."""

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize


def ranked(rows: DataFrame, order: list[str], within: list[str] = [], out: str = "idx") -> DataFrame:  # noqa: B006
    """`rows` with their place `out`, from 0, in `order` among those that agree in `within`; nulls come first.

    Rows are dealt by ranges of all these columns and the order of reading, so a hot value is split like any other
    run of rows; what lies before a partition is added up from one number per partition and group.
    """
    by = [*within, *order, "_seq"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written down: the partition number is part of the result
    ranged = rows.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(parts, *by)
    ranged = materialize(ranged.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*within, "_part").agg(F.count("*").alias("_n"))
    counts = materialize(counts.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    counts = counts.toDF(*[f"_w{i}" for i in range(len(within))], "_p", "_base")
    on = F.col("_part") == F.col("_p")
    for i, c in enumerate(within):
        on = on & F.col(c).eqNullSafe(F.col(f"_w{i}"))
    own = F.row_number().over(Window.partitionBy("_part", *within).orderBy(*order, "_seq")) - 1
    placed = ranged.withColumn("_own", own).join(counts, on)
    return placed.withColumn(out, F.col("_base") + F.col("_own")).select(*rows.columns, out)
