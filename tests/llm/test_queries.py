"""The queries of this subpackage against their DuckDB statements, and what holds for all of its code."""

from pathlib import Path

import pytest

import __spark_entry__ as registry
from edgetide.llm import queries as llm
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
FILES = sorted(Path(llm.__file__).parent.glob("*.py"))
NATIVE = ["quality_rules", "entropy_mix", "template_leaks", "feistel", "license_join"]


@pytest.mark.parametrize("name", [*llm.queries(), "pipeline"])
def test_query(spark, name):
    ok, note = compare(spark, connect(FOLDER), FOLDER, name)
    assert ok, note


def test_all_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in llm.queries()} == set(range(1, 14))
    assert set(llm.queries()) | {"pipeline"} == set(registry.queries()) - set(registry.graph_queries())
    assert set(llm.oracle_sql()) <= set(llm.queries())


def test_native_operators_have_no_python_on_the_way():
    for path in FILES:
        text = path.read_text()
        assert "local" + "Checkpoint" not in text and "crossJoin" not in text, path
        if path.stem in NATIVE:
            assert not any(word in text for word in ("mapIn", "applyIn", "udf(", ".rdd", "import pandas", "import pyarrow")), path
