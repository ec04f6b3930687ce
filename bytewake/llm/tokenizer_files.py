"""Vocabulary files of public tokenizers; they stay where they are installed."""

from __future__ import annotations

import importlib.util
import os


def installed() -> bool:
    return importlib.util.find_spec("public_tokenizers") is not None


def path(name: str, folder: str | None = None) -> str:
    """A vocabulary file in ``folder``, or in the installed package of them."""
    if folder is not None:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def content(name: str, folder: str | None = None) -> bytes:
    with open(path(name, folder), "rb") as file:
        return file.read()
