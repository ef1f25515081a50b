from datetime import datetime, timedelta

from shelfwise.catalog import q_monitoring as Q


class Rows:
    """Stands for the tables: 150 sources and 40 finished lines."""

    def __init__(self, spark):
        self.spark = spark
        lines = [(n, 1, n, n, 3.0, 10.0, "F", datetime(1998, 1, 1) + timedelta(days=n)) for n in range(40)]
        self.lineitem = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_linestatus string, l_shipdate timestamp_ntz")
        self.supplier = spark.createDataFrame([(n, f"S{n}", n % 25, 1.0) for n in range(150)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


def test_recent_alerts_lists_every_alert(spark):
    found = Q.recent_alerts(Rows(spark)).collect()
    assert len(found) == 190 and len({r["fingerprint"] for r in found}) == 190
    assert [r["created_at"] for r in found] == sorted((r["created_at"] for r in found), reverse=True)
