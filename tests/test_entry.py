import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0].n == max(r.n for r in rows)


def test_the_rest_works_without_the_corpus_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q = e.queries(); e.oracle_sql(); assert len(q) > 100 and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, timeout=120)


def test_plans_stay_in_the_jvm(spark):
    """No Python where an expression does, filters and columns reach the scan, and small tables are pre-aggregated."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no tables here")
    python = {"prj53_half_width", "prj62_written_numbers", "prj72_located_entities", "smp13_voiced_segments", "udf01_annotator", "agg29_word_error_rate", "agg30_error_kinds", "agg29_character_error_rate", "agg31_dropped_words", "agg31_mean_error_rate", "agg33_labelled_error_rate", "agg35_family_error_rate"}
    from tagloom import plans

    for name, query in plans.QUERIES.items():
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert any(p in plan for p in ("Python", "Pandas", "Arrow")) is (name in python), name
        assert "CartesianProduct" not in plan, name
    plan = plans.QUERIES["win01_first_per_key"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("ReadSchema")[1].splitlines()[0] and "partial_min_by" in plan
