"""Paths that stay where they start: of addresses to files, and of files on this machine."""

from __future__ import annotations

import os
import stat
from urllib.parse import unquote, urlsplit

#: Kinds of files that are served. Fixed values.
SERVED = (".html", ".css", ".js", ".json", ".svg", ".png", ".jpg", ".txt", ".ico", ".webmanifest")


class PathError(ValueError):
    """A path that leads elsewhere."""


def static_path(root: str, address: str) -> str | None:
    """The file under ``root`` that an address names, decoded once; None for what is hidden, elsewhere, no file or of no served kind."""
    path = unquote(urlsplit(address).path)
    if "\x00" in path or "\\" in path or "%" in path or not path.startswith("/"):
        return None
    steps = [s for s in path.split("/") if s] or ["index.html"]
    if any(s.startswith(".") or ":" in s for s in steps) or not steps[-1].lower().endswith(SERVED):
        return None
    try:
        found = checked_path(os.path.join(root, *steps), root)
    except PathError:
        return None
    return found if os.path.isfile(found) else None


def checked_path(path: str, root: str, missing: bool = False) -> str:
    """The path, if each step from the root to it is there, is no link, and stays below the root; its last step may be missing on request."""
    root, path = os.path.abspath(root), os.path.abspath(path)
    if os.path.commonpath([root, path]) != root:
        raise PathError(f"{path} is not below {root}")
    steps = os.path.relpath(path, root).split(os.sep)
    at = root
    for i, step in enumerate(["."] if steps == ["."] else steps):
        at = os.path.normpath(os.path.join(at, step))
        try:
            kind = os.lstat(at).st_mode
        except FileNotFoundError as e:
            if missing and i == len(steps) - 1:
                return path
            raise PathError(f"{at} is not there") from e
        if stat.S_ISLNK(kind):
            raise PathError(f"{at} is a link")
    return path
