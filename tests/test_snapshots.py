import json
import os
import random
import zipfile

import numpy as np
import pytest

from millrace.operators import decoder
from millrace.sources import snapshots


def test_digest_of_values():
    digest = snapshots.value_digest
    assert digest({"a": 1, "b": [1, 2]}) == digest({"b": [1, 2], "a": 1})
    several = [1, 1.0, True, "1", b"1", None, [1], (1,), {"1": 1}, {1: 1}, [], {}, "", np.array([1]), np.array([1.0]), np.array([[1]]), [[1], []], [[], [1]], ["ab", "c"], ["a", "bc"]]
    assert len({digest(v) for v in several}) == len(several)
    with pytest.raises(TypeError):
        digest(object())


def test_round_trip_and_latest(tmp_path):
    folder = f"{tmp_path}/run"
    weights = decoder.random_weights(decoder.Config(300, width=8, heads=2, layers=1, longest=16), 3)
    for step in (1, 2):
        digest = snapshots.save_latest(folder, f"step-{step}.zip", weights, {"step": step, "rate": 0.5})
    arrays, settings = snapshots.load_latest(folder)
    assert settings == {"step": 2, "rate": 0.5} and set(arrays) == set(weights) and all(np.array_equal(arrays[k], w) for k, w in weights.items())
    assert digest == snapshots.value_digest({"arrays": weights, "settings": settings}) and sorted(os.listdir(folder)) == ["latest.json", "step-1.zip", "step-2.zip"]


def test_changed_or_other_snapshots_are_errors(tmp_path):
    path = f"{tmp_path}/s.zip"
    snapshots.save(path, {"a": np.arange(3)}, {"n": 1})
    for change in ({"settings": {"n": 2}}, {"version": "0"}):
        with zipfile.ZipFile(path) as source:
            parts = {n: source.read(n) for n in source.namelist()}
        meta = json.loads(parts["meta.json"]) | change
        with zipfile.ZipFile(f"{path}.odd", "w") as out:
            for name, content in (parts | {"meta.json": json.dumps(meta)}).items():
                out.writestr(name, content)
        with pytest.raises(ValueError):
            snapshots.load(f"{path}.odd")
    with pytest.raises(TypeError):
        snapshots.save(path, {}, {"odd": object()})
    assert snapshots.load(path)[1] == {"n": 1} and os.listdir(tmp_path).count("s.zip") == 1


def test_random_state():
    state = json.loads(json.dumps(snapshots.random_state(7)))
    first = [random.random(), float(np.random.rand())]
    snapshots.restore_random_state(state)
    assert first == [random.random(), float(np.random.rand())]
