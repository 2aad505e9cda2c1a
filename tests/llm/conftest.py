import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))  # oracle.py

from plain import SF


@pytest.fixture(scope="session")
def con():
    from oracle import connect

    return connect(SF)


@pytest.fixture(scope="session")
def documents(con):
    """(doc_id, text, lang, source) of the smallest table."""
    return con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
