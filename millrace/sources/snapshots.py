"""Snapshots of a run's state: named arrays and plain settings in one file, replaced at once, without pickled code; digests of their values."""

from __future__ import annotations

import hashlib
import io
import json
import os
import random
import zipfile
from collections.abc import Mapping

import numpy as np

from millrace.sources.config import latest, point_to

VERSION = "1.0.0"


def value_digest(value: object) -> str:
    """Digest of a nested value by what it holds: each part's own digest, under its type's name, goes into that of the whole, so that neither the order of a
    mapping's keys nor a file's format counts, while 1, 1.0, True and "1" differ. A type that isn't plain is an error."""

    def of(kind: str, *parts: bytes) -> bytes:
        whole = hashlib.sha256(kind.encode() + b"\x00")
        for part in parts:
            whole.update(hashlib.sha256(part).digest())
        return whole.digest()

    def walk(v: object) -> bytes:
        if v is None or isinstance(v, (bool, int, float, str)):
            return of(type(v).__name__, repr(v).encode())
        if isinstance(v, bytes):
            return of("bytes", v)
        if isinstance(v, np.ndarray):
            return of("array", v.dtype.str.encode(), repr(v.shape).encode(), np.ascontiguousarray(v).tobytes())
        if isinstance(v, Mapping):
            return of("mapping", *sorted(walk(k) + walk(x) for k, x in v.items()))
        if isinstance(v, (list, tuple)):
            return of(type(v).__name__, *map(walk, v))
        raise TypeError(f"no digest of {type(v).__name__}")

    return walk(value).hex()


def save(path: str, arrays: Mapping[str, np.ndarray], settings: Mapping[str, object]) -> str:
    """Writes a snapshot beside its place and moves it there at once; its digest by value."""
    meta = {"version": VERSION, "settings": dict(settings), "digest": value_digest({"arrays": dict(arrays), "settings": json.loads(json.dumps(settings))})}
    new = f"{path}.{os.getpid()}.new"
    try:
        with zipfile.ZipFile(new, "w") as out:
            out.writestr("meta.json", json.dumps(meta, sort_keys=True))
            for name, array in arrays.items():
                held = io.BytesIO()
                np.save(held, array, allow_pickle=False)
                out.writestr(f"arrays/{name}.npy", held.getvalue())
        os.replace(new, path)
    finally:
        if os.path.exists(new):
            os.remove(new)
    return meta["digest"]


def load(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """A snapshot's arrays and settings; another version, or values that aren't those that were saved, is an error."""
    with zipfile.ZipFile(path) as source:
        meta = json.loads(source.read("meta.json"))
        if meta.get("version") != VERSION:
            raise ValueError(f"snapshot version is {meta.get('version')!r}, not {VERSION!r}")
        names = [n for n in source.namelist() if n.startswith("arrays/")]
        arrays = {n.removeprefix("arrays/").removesuffix(".npy"): np.load(io.BytesIO(source.read(n)), allow_pickle=False) for n in names}
    if value_digest({"arrays": arrays, "settings": meta["settings"]}) != meta["digest"]:
        raise ValueError(f"snapshot's values changed: {path}")
    return arrays, meta["settings"]


def save_latest(folder: str, name: str, arrays: Mapping[str, np.ndarray], settings: Mapping[str, object]) -> str:
    """Saves a snapshot in a folder and then sets the folder's latest pointer to it."""
    os.makedirs(folder, exist_ok=True)
    digest = save(os.path.join(folder, name), arrays, settings)
    point_to(folder, name)
    return digest


def load_latest(folder: str) -> tuple[dict[str, np.ndarray], dict]:
    return load(latest(folder))


def random_state(seed: int | None = None) -> dict[str, object]:
    """Python's and numpy's random state as plain values; with a seed, of both set anew by it."""
    if seed is not None:
        random.seed(seed)
        np.random.seed(seed % (1 << 32))
    kind, keys, at, has, cached = np.random.get_state()
    version, inner, gauss = random.getstate()
    return {"python": [version, list(inner), gauss], "numpy": [kind, keys.tolist(), at, has, cached]}


def restore_random_state(state: Mapping[str, list]) -> None:
    version, inner, gauss = state["python"]
    random.setstate((version, tuple(inner), gauss))
    kind, keys, at, has, cached = state["numpy"]
    np.random.set_state((kind, np.array(keys, np.uint32), at, has, cached))
