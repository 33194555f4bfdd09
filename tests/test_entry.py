"""The library without its corpus operators."""

import importlib.util

import __spark_entry__ as entry


def test_queries_without_the_corpus_package(monkeypatch):
    found = importlib.util.find_spec

    def hidden(name, *args):
        return None if name.startswith("netwarden.llm") else found(name, *args)

    monkeypatch.setattr(importlib.util, "find_spec", hidden)
    names = set(entry.queries())
    assert names and set(entry.oracle_sql()) <= names
    assert not any(name.startswith("op") or name == "pipeline" for name in names)


def test_the_pipeline_alone_is_left_out(monkeypatch):
    """Where only the pipeline's file is missing, the corpus queries are still there."""
    found = importlib.util.find_spec
    monkeypatch.setattr(
        importlib.util, "find_spec", lambda name, *args: None if name == "corpus_pipeline" else found(name, *args)
    )
    names = entry.queries()
    assert "pipeline" not in names
