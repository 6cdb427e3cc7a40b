"""Collapse of a SAM file repeated N times with unique read ids; prints one JSON line of wall seconds.

    python bench_reads.py reads.sam genome.fa [capped|no_cap] [N ...]
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spliceflow.operators import collapse
from spliceflow.sources import readers

CPUS = os.environ.get("BENCH_CPUS", "8")


def main(sam: str, genome: str, cap: str = "capped", *sizes: str) -> None:
    began = time.time()
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    up, out = round(time.time() - began, 2), {}
    for n in map(int, sizes or ("1", "1", "10", "100", "500")):
        rows = readers.sam(spark, sam)
        copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("read_id", F.concat_ws("#", "read_id", "copy")).withColumn("ord", F.col("ord") * n + F.col("copy")).drop("copy")
        began = time.time()
        accepted = collapse.read_metrics(copies.repartition(int(CPUS)), readers.fasta(spark, genome)).where("accepted").cache()
        models, members = collapse.collapse(accepted, cap == "capped")
        models.select("line").write.format("noop").mode("overwrite").save()
        members.select("line").write.format("noop").mode("overwrite").save()
        out[str(n)] = round(time.time() - began, 2)  # a repeated size counts as it runs warm
        accepted.unpersist()
        print(n, out[str(n)], file=sys.stderr)
    print(json.dumps({"metric": f"collapse {cap}, wall time", "unit": "sec", "session_start": up, "copies": out}))


if __name__ == "__main__":
    main(*sys.argv[1:])
