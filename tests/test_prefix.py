import random

from pyspark.sql import functions as F

from millrace import prefix


def test_running_sums_over_a_hot_key_and_null_keys(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice(["hot", "hot", "hot", "hot", "cold", None]), i, rnd.randrange(5)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, o long, v long")
    got = prefix.running(df, ["k"], [F.col("o")], {"before": F.col("v"), "place": F.lit(1)}, rows=50)
    want, sums, places = {}, {}, {}
    for k, o, v in rows:
        want[o] = (sums.get(k, 0), places.get(k, 0))
        sums[k], places[k] = sums.get(k, 0) + v, places.get(k, 0) + 1
    assert {r.o: (r.before, r.place) for r in got.collect()} == want
    assert got.select(prefix.PART).distinct().count() > 10


def test_without_keys_and_on_an_empty_table(spark):
    df = spark.range(1000).repartition(7)
    got = prefix.running(df, [], [F.col("id")], {"place": F.lit(1)}, rows=64)
    assert all(r.id == r.place for r in got.collect())
    assert prefix.running(df.limit(0), [], [F.col("id")], {"place": F.lit(1)}).collect() == []
