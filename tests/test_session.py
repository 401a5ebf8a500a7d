from __future__ import annotations

from pathlib import Path

import pytest

from sievemill import session


def _path(url: str) -> Path:
    return Path(url.removeprefix("file:"))


def test_folders_of_a_query_go_with_it(spark):
    with session.working():
        df = session.stored(spark.range(3), "test")
        path = _path(session._made[-1][1])
        assert df.count() == 3 and path.exists()
    assert not path.exists()


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        class _jsc:  # noqa: N801
            @staticmethod
            def sc():
                class Jsc:
                    @staticmethod
                    def getCheckpointDir():
                        class No:
                            @staticmethod
                            def isDefined():
                                return False

                        return No

                return Jsc

    class Session:
        sparkContext = Context

        class conf:  # noqa: N801
            @staticmethod
            def get(key, default):
                return default

    with pytest.raises(ValueError, match="checkpoint"):
        session.shared_dir(Session)
