from trackspark.operators.near import crowded


def test_lone_points_go_before_cells_are_copied(spark):
    lone = [("a", k, 10 * k, 7 * k) for k in range(50)]
    corner = [("a", 100 + k, 999 + 2 * (k % 2), -1001 + 2 * (k // 2)) for k in range(4)]  # two cells apart, in four blocks
    df = spark.createDataFrame(lone + corner, "k string, id int, _i long, _j long")
    assert sorted(r.id for r in crowded(df, ["k"], 4).collect()) == [100, 101, 102, 103]
