"""A library that an operator needs isn't passed over if it is missing."""

import importlib
import sys

import pytest

from ..test_storage import Missing


def test_a_missing_library_is_an_error(monkeypatch):
    for loaded in [x for x in sys.modules if x.partition(".")[0] in ("corpus_pipeline", "__spark_entry__", "xxhash") or x.startswith("netloom.llm")]:
        monkeypatch.delitem(sys.modules, loaded)
    monkeypatch.setattr(sys, "meta_path", [Missing("xxhash"), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        importlib.import_module("__spark_entry__")
