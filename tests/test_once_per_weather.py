"""What belongs to a weather or a candidate alone is found once, and the scores of all weathers are made once."""

from pyspark.sql import functions as F

from wakeline.operators import scoring as sc
from wakeline.operators.drift import displaced, drift_velocity, hashed_uniform
from wakeline.functions.geo import haversine_km

KIND = "scene_id long, mmsi string, lat double, lon double, release_s long, captured_s long, spill_lat double, spill_lon double, wind_u double, wind_v double, cur_u double, cur_v double"
ROWS = [
    (1, "419000001", 18.0, 70.0, 0, 3600, 18.01, 70.02, 3.0, 1.0, 0.1, 0.2),
    (1, "419000002", 18.0, 70.1, 600, 3600, 18.01, 70.02, 3.0, 1.0, 0.1, 0.2),
    (2, "419000003", -5.0, 70.0, 0, 7200, -5.1, 70.1, -2.0, 4.0, -0.1, 0.0),
    (2, "419000004", None, 70.0, 0, 7200, -5.1, 70.1, -2.0, 4.0, -0.1, 0.0),
]


def test_scores_equal_the_plain_form_to_the_last_bit(spark):
    c = spark.createDataFrame(ROWS, KIND)
    d = c.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(20).cast("long"))))
    base, run = F.col("run") == 0, F.col("run")
    factor = F.when(base, 1.0).otherwise(1 - sc.WIND_SPREAD + 2 * sc.WIND_SPREAD * hashed_uniform(run, seed=42))
    turn = F.when(base, 0.0).otherwise(-sc.TURN_DEG + 2 * sc.TURN_DEG * hashed_uniform(run, seed=43))
    u, v = drift_velocity(F.col("wind_u"), F.col("wind_v"), F.col("cur_u"), F.col("cur_v"), F.col("lat"), factor, turn)
    lat, lon = displaced(F.col("lat"), F.col("lon"), u, v, F.col("captured_s") - F.col("release_s"))
    km = haversine_km(lat, lon, F.col("spill_lat"), F.col("spill_lon"))
    plain = d.select("scene_id", "mmsi", "run", F.round(F.greatest(F.lit(0.0), 1 - km / sc.FORWARD_KM), 6).alias("score"))
    assert sorted(map(tuple, sc.perturbed_scores(c, 20).collect())) == sorted(map(tuple, plain.collect()))


def test_all_weathers_are_scored_in_one_pass(spark):
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(mmsi):
        asked.add(1)
        return mmsi

    c = spark.createDataFrame(ROWS[:3], KIND)
    runs = sc.perturbed_scores(c, 20).withColumn("mmsi", seen.asNondeterministic()("mmsi"))
    assert sc.sensitivity_test(runs, 20).count() == 2
    assert asked.value == 3 * 21
