"""Parser models that are checked before they are used: the very bytes whose size and digest fit are the ones loaded."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Model:
    """A model file by name, with the size and SHA-256 it must have."""

    name: str
    size: int
    sha256: str


# Fixed values of the English model.
ENGLISH = Model("english-ewt-ud-2.5-191206.udpipe", 16_309_608, "784bd0fa85e3d831fd02a55290d0acfd05c953159dc38cc33d52e1b28add9957")


class ModelInvalid(RuntimeError):
    """A model that isn't what it should be."""


def checked(path: str, model: Model) -> bytes | None:
    """The file's bytes if size and digest fit, from one read; a wrong size isn't read at all."""
    if os.path.getsize(path) != model.size:
        return None
    with open(path, "rb") as file:
        data = file.read()
    return data if hashlib.sha256(data).hexdigest() == model.sha256.lower() else None


def fetched(folder: str, model: Model, fetch: Callable[[str], None]) -> None:
    """Let `fetch` write the file into a folder of this process's own, then move it into place in one step."""
    own = os.path.join(folder, f".fetch.{os.getpid()}")
    shutil.rmtree(own, ignore_errors=True)
    os.makedirs(own)
    try:
        part = os.path.join(own, model.name)
        fetch(part)
        os.replace(part, os.path.join(folder, model.name))
    finally:
        shutil.rmtree(own, ignore_errors=True)


def load(folder: str, model: Model = ENGLISH, fetch: Callable[[str], None] | None = None) -> bytes:
    """The model's bytes from a folder; fetched if it isn't there, and once more if what is there doesn't fit.

    Without `fetch` nothing is downloaded: a missing model raises FileNotFoundError, a wrong one ModelInvalid.
    """
    path = os.path.join(folder, model.name)
    if not os.path.exists(path) and fetch is None:
        raise FileNotFoundError(f"model not found: {path}")
    os.makedirs(folder, exist_ok=True)
    if not os.path.exists(path):
        fetched(folder, model, fetch)
    data = checked(path, model)
    if data is None and fetch is not None:
        os.remove(path)
        fetched(folder, model, fetch)
        data = checked(path, model)
    if data is None:
        raise ModelInvalid(f"invalid model: size or SHA-256 of {path} doesn't fit")
    return data
