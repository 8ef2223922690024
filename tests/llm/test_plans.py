"""Plans of the operators: built-in functions only where that is asked for, no pairs of everything."""

import inspect

import pytest

from conftest import SF001
from fedsearch.llm import decontamination, fingerprints, mixing, pii, quality, queries


@pytest.mark.parametrize("name", ["op1_mix_sources", "op3_fingerprints", "op4_quality_rules", "op5_personal_data",
                                  "op13_benchmark_decontamination"])
def test_no_python_runs_on_the_executors(spark, name):
    df = queries.QUERIES[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("module", [decontamination, fingerprints, mixing, pii, quality])
def test_native_modules_hold_no_user_functions(module):
    source = inspect.getsource(module)
    assert not any(x in source for x in ("udf(", "mapIn", "applyIn", ".rdd", "import pandas", "import numpy"))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cross_joins(spark, name):
    plan = queries.QUERIES[name](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
