"""Labels at the bounds of the volatility index do not hang on how the table's files are split."""

import datetime

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from tidewright.sources import bars


def test_a_mean_on_a_bound_is_summed_in_row_order(spark, tmp_path):
    rng = np.random.default_rng(4)
    halves = [rng.integers(0, 9, n) for n in [12] * 40 + [150] * 40]
    tax = np.concatenate([np.concatenate([x, 8 - x]) for x in halves]) / 100  # 80 dates of mean 0.04
    day = np.repeat(np.arange(80), [2 * len(x) for x in halves])
    order = rng.permutation(len(tax))
    dates = pa.array([datetime.datetime(2000, 1, 1) + datetime.timedelta(int(d)) for d in day[order]], pa.timestamp("us"))
    pq.write_table(pa.table({"l_shipdate": dates, "l_tax": tax[order]}), tmp_path / "lineitem.parquet", row_group_size=500)
    con = duckdb.connect(config={"threads": 1})
    sql = f"SELECT CAST(l_shipdate AS DATE) AS date, 500 * AVG(l_tax) AS vix FROM '{tmp_path}/lineitem.parquet' GROUP BY 1"
    want = {d: v for d, v in con.sql(sql).fetchall()}
    assert len({v > 20 for v in want.values()}) == 2  # noise falls on both sides
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        table = bars.vix_of_tables(spark, str(tmp_path))
        assert {r.date: r.vix for r in table.collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
