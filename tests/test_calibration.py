"""The default calibration reports what its operator finds."""

import numpy as np

from assetloom.plans import queries


def test_default_threshold_follows_the_table(spark, tmp_path):
    # Pairs at a distance of 0.1 or 0.12, each pair on axes of its own: the histogram of 40 bins over [0, 0.5] falls
    # after bin 8, so bin 9 is the first drop.
    rows = []
    for k in range(40):
        far = 0.105 if k < 30 else 0.118
        one, two = np.zeros(80), np.zeros(80)
        one[2 * k], two[2 * k], two[2 * k + 1] = 1, 1 - far, np.sqrt(1 - (1 - far) ** 2)
        rows += [(2 * k, one.tolist(), k), (2 * k + 1, two.tolist(), k)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["calibrate_threshold_default"](spark, str(tmp_path)).first().threshold
    assert abs(got - 9.5 * 0.0125) < 1e-9
