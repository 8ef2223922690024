import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from fedsearch.session import clean_scratch, get_spark
    s = get_spark("local[8]", app="fedsearch-tests", shuffle_partitions=8)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    clean_scratch(s)
