from datetime import date, timedelta

import duckdb

from corpusloom.plans import lookups

MOST = 92_233_720  # the last count of 100,000 s that is a timestamp


def days(spark, path, counts):
    spark.createDataFrame([(n, "a") for n in counts], "entry_no bigint, title string").write.parquet(f"{path}/episodes.parquet")
    return {r["entry_no"]: r["day"] for r in lookups.f35_hashes_and_days(spark, str(path)).collect()}


def test_days_as_in_sql(spark, tmp_path):
    counts = [None, 0, 1, -1, 2_534_023, 2_534_024, 6_000_000, MOST, -600_000, -719_000, -1_000_000, -MOST]
    got = days(spark, tmp_path, counts)
    duck = duckdb.connect()
    duck.execute(f"SET TimeZone = 'UTC'; CREATE VIEW episodes AS SELECT * FROM read_parquet('{tmp_path}/episodes.parquet/*.parquet')")
    assert got == {n: day for n, _, _, day in duck.sql(lookups.SQL["f35_hashes_and_days"]).fetchall()} and len(got) == len(counts)


def test_days_beyond_timestamps(spark, tmp_path):
    def day(n):
        turns, rest = divmod(n * 100_000, 12_622_780_800)  # 400 years
        at = date(1970, 1, 1) + timedelta(seconds=rest)
        return f"{at.year + turns * 400}-{at:%m-%d}"[:10]

    turn = 15_778_476  # 50,000 years
    got = days(spark, tmp_path, [MOST + 1, -MOST - 1, 6 * turn, 6 * turn - 1, -6 * turn, -6 * turn - 1, 10**9, 10**14, 2**63 - 1, -(2**63)])
    assert len(got) == 10 and got == {n: day(n) for n in got}
    assert got[6 * turn] == "301970-01-" and got[10**9] == "3170843-11"
