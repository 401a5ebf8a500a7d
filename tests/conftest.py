from __future__ import annotations

import pytest

from sievemill.session import local_session, ship


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "4g")
    ship(s)
    return s
