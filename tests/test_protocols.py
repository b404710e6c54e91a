"""What stands in for the stored vectors is asked for its scores."""

from pyspark.sql import functions as F

from skein.plans import retrieval_queries as RQ
from skein.protocols import DenseSeeds

SF = "/root/testdata/sf0.001"


class Own:
    def score(self, tasks):
        return tasks.select("task_id", F.explode(F.array(F.lit("d0000007"), F.lit("unknown"))).alias("id"), F.lit(0.5).alias("score"))


def test_own_dense_seeds_are_a_channel(spark):
    assert isinstance(Own(), DenseSeeds)
    tasks = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    got = RQ.seeds(spark, SF, dense=Own()).where("id = 'd0000007'").collect()
    assert len(got) == tasks and all("seed:embed" in r["why"] for r in got)
    assert RQ.seeds(spark, SF, dense=Own()).where("id = 'unknown'").isEmpty()
