from skewlens.session import ensure_checkpoint_dir, scratch_path


def test_scratch_goes_below_the_sessions_checkpoint_dir(spark):
    base = ensure_checkpoint_dir(spark)
    assert base == spark.sparkContext.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:  # set by the environment: Spark keeps a per-application folder below it
        assert base.replace("file:", "").startswith(configured.replace("file:", "").rstrip("/"))
    a, b = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert a != b and a.startswith(base.rstrip("/") + "/skewlens/x-")


def test_get_session_leaves_an_active_session_untouched(spark):
    from skewlens.session import get_session
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        assert get_session(shuffle_partitions=3) is spark
        assert spark.conf.get("spark.sql.session.timeZone") == "Asia/Tokyo"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
