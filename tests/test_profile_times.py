from quarrion.plans import training


def test_profile_shows_altered_timestamps(spark, tmp_path):
    """A load with shifted, constant or epoch timestamps diverges from the source's others."""
    spark.sql("select k as load_no, timestamp'2025-01-06' + make_dt_interval(7 * (k - 1)) as week_start, timestamp'2025-01-06' + make_dt_interval(7 * k) as week_end from (select cast(id as int) as k from range(1, 10))").write.parquet(str(tmp_path / "load_calendar.parquet"))
    rows = spark.sql("""
        select k as load_no, 's' as source, i as price,
          case k when 3 then seen - interval 400 days when 5 then date_trunc('week', seen) when 7 then timestamp'1970-01-01 00:00:00' else seen end as last_seen
        from (select *, timestamp'2025-01-06' + make_dt_interval(7 * (k - 1), i % 160, i % 60, 7) as seen from (select cast(id as int) as k from range(1, 10)), (select id as i from range(400)))""")
    rows.write.parquet(str(tmp_path / "listing_snapshots.parquet"))
    out = {r.load_no: r for r in training.QUERIES["p6_profile"](spark, str(tmp_path)).where("column_name = 'last_seen'").collect()}
    assert {k for k, r in out.items() if r.divergence > 0.3} == {3, 5, 7} and len(out) == 9
    assert all((r.n_violations > 100) == (k in (3, 7)) for k, r in out.items() if k != 5)
