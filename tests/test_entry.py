import runpy
import sys
from pathlib import Path

import pytest

ENTRY = str(Path(__file__).parents[1] / "__spark_entry__.py")


def _without(monkeypatch, missing):
    for name in [m for m in sys.modules if m.split(".")[:2] == ["lodeseek", "llm"]]:
        monkeypatch.delitem(sys.modules, name)
    if llm := sys.modules.get("lodeseek"):
        monkeypatch.delattr(llm, "llm", raising=False)
    monkeypatch.setitem(sys.modules, missing, None)


def test_a_missing_dependency_is_no_missing_subpackage(monkeypatch):
    _without(monkeypatch, "xxhash")
    with pytest.raises(ImportError):
        runpy.run_path(ENTRY)


def test_core_goes_without_the_subpackage(monkeypatch):
    _without(monkeypatch, "lodeseek.llm")
    names = runpy.run_path(ENTRY)["queries"]()
    assert "search_hybrid" in names and "p6_found" not in names
