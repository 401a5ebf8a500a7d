from __future__ import annotations

import pytest

from sievemill import config

DEFAULTS = {"data": {"seed": 13, "sources": ["a"]}, "run": {"name": "x", "out": "/tmp"}}


def test_layers_merge_in_order():
    c = config.load(DEFAULTS, {"data": {"seed": 14}}, {"SIEVEMILL__RUN__NAME": "env", "OTHER": "1"}, ["data.sources=[\"b\"]", "run.out=here"])
    assert c == {"data": {"seed": 14, "sources": ["b"]}, "run": {"name": "env", "out": "here"}} and DEFAULTS["data"]["seed"] == 13
    with pytest.raises(KeyError, match="no.such"):
        config.load(DEFAULTS, settings=["no.such=1"], env={})


def test_hash_ignores_order_and_paths():
    a, b = {"x": {"p": 1, "q": 2}, "y": 3}, {"y": 3, "x": {"q": 9, "p": 1}}
    assert config.config_hash(a) != config.config_hash(b) and config.config_hash(a, {"x.q"}) == config.config_hash(b, {"x.q"})


def test_tasks():
    assert config.tasks_for(["a", "b", "c"], {"aug.more": ["b"], "aug.most": ["c"]}, {"aug": {"more": 0.5}}) == ["a", "b"]
