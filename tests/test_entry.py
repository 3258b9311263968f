import importlib
import re
import sys

import pytest


@pytest.mark.parametrize("missing", ["corpus_pipeline", "listforge.llm"])
def test_entry_without_the_training_data_part(monkeypatch, missing):
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("listforge.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)
    entry = importlib.import_module("__spark_entry__")
    assert "shortlist_batch" in entry.queries() and not any(re.match(r"op\d|pipeline", n) for n in entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__")
