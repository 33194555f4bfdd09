import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from netwarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session()
    yield session
    session.stop()


@pytest.fixture
def tiny(monkeypatch):
    """Limits so low that the paths for large data run on a few rows."""
    from netwarden.operators import cooldown, neighbours
    from netwarden.plans import scale

    monkeypatch.setattr(scale, "SMALL_ROWS", 3)
    monkeypatch.setattr(scale, "GROUP_ROWS", 16)
    monkeypatch.setattr(neighbours, "BLOCK_ROWS", 8)
    monkeypatch.setattr(cooldown, "DIRECT_STEPS", 4)
    monkeypatch.setattr(cooldown, "FANOUT", 2)
    monkeypatch.setattr(cooldown, "SPAN", 2)
