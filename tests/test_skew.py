"""Hot keys: with a tiny row bound the sliced forms must give the same."""

import os

import pytest

from __spark_entry__ import queries
from tests.compare import table

SF = "/root/testdata/sf0.001"
KEYS = ["evt01_sessionize", "evt14_npath", "evt16_attribution", "evt11_event_path", "wn01_row_number_global", "wn01_row_number", "wn02_rank", "wn03_ntile", "wn04_lag_lead", "wn07_running_sum",
        "ag04_percentiles", "dq18_concentration", "dq14_histogram_equal_freq", "ev07_homoscedasticity", "ts29_result_deciles", "fp09_train_test_split", "fp09_split_unstratified", "ts04_fill_linear", "ts08_acf", "ts14_seasonal_decompose",
        "ts20_smooth_exponential", "ts20_smooth_kalman", "ts24_change_point", "sp21_convolve_same", "tx05_tfidf_transform"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("key", KEYS)
def test_same_result(spark, key):
    q = queries()[key]
    plain = table(q(spark, SF))
    spark.conf.set("spark.cairn.taskRows", "50")
    try:
        assert table(q(spark, SF)) == plain
    finally:
        spark.conf.unset("spark.cairn.taskRows")
