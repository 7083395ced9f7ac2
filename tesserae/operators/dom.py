"""Preview trees as a closed grammar: one walk in document order that ends at the first fault.

A tree is an object with the keys below; ``children`` holds trees. Depth, breadth, and
the number of all nodes together are bounded. A fault is named by its place and what is
wrong there: ``2.0:text`` is the text of the first child of the third child.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd

from tesserae.functions import arrow

# What a preview may be made of.
TAGS = ("div", "span", "p", "strong", "em", "h1", "h2", "button", "input", "label")
CLASS_CHARS, TEXT_CHARS, HINT_CHARS = 180, 64, 80
VARIABLES, VARIABLE_CHARS = 32, 240
VARIABLE_NAME = re.compile(r"--[A-Za-z_][A-Za-z0-9_-]{0,70}")
VARIABLE_VALUE = re.compile(r"[A-Za-z0-9#().,%\s_+-]+")
FETCHING = re.compile(r"(?:url|expression|image-set|attr)\s*\(", re.I)


@dataclass(frozen=True)
class Bounds:
    """How large a tree may be, and what a class is called."""

    nodes: int
    children: int
    class_name: re.Pattern
    depth: int = 5


#: A preview that comes with an asset, and one that was drawn for a review.
PREVIEW = Bounds(96, 48, re.compile(r"[A-Za-z_][\w-]*"))
ILLUSTRATION = Bounds(64, 32, re.compile(r"[A-Za-z_][A-Za-z0-9_-]*"))


def _short(most: int) -> Callable[[object, Bounds], bool]:
    return lambda value, _: isinstance(value, str) and len(value) <= most


def _classes(value: object, bounds: Bounds) -> bool:
    if not isinstance(value, str) or len(value) > CLASS_CHARS:
        return False
    return value == "" or all(map(bounds.class_name.fullmatch, re.split(" +", value)))


def _variables(value: object, _: Bounds) -> bool:
    if not isinstance(value, dict) or len(value) > VARIABLES:
        return False
    said = all(isinstance(v, str) and len(v) <= VARIABLE_CHARS for v in value.values())
    return said and all(VARIABLE_NAME.fullmatch(k) and VARIABLE_VALUE.fullmatch(v) and not FETCHING.search(v) for k, v in value.items())


#: Key -> whether its value is as it must be.
KEYS: dict[str, Callable[[object, Bounds], bool]] = {
    "tag": lambda value, _: isinstance(value, str) and value in TAGS,
    "className": _classes,
    "text": _short(TEXT_CHARS),
    "placeholder": _short(HINT_CHARS),
    "variables": _variables,
    "children": lambda value, bounds: isinstance(value, list) and len(value) <= bounds.children,
}


def walked(tree: object, bounds: Bounds = PREVIEW) -> tuple[int, str | None]:
    """The nodes seen, and the first fault in document order (None: the tree is sound)."""
    ahead: list[tuple[str, object, int]] = [("", tree, 0)]
    seen = 0
    while ahead:
        place, node, depth = ahead.pop()
        if not isinstance(node, dict):
            return seen, f"{place}:node"
        if seen == bounds.nodes or depth > bounds.depth:
            return seen, f"{place}:{'nodes' if seen == bounds.nodes else 'depth'}"
        seen += 1
        if node.keys() - KEYS.keys():
            return seen, f"{place}:key"
        for key, sound in KEYS.items():
            if key in node and not sound(node[key], bounds):
                return seen, f"{place}:{key}"
        below = node.get("children", ())
        ahead += [(f"{place}.{i}" if place else str(i), child, depth + 1) for i, child in reversed(list(enumerate(below)))]
    return seen, None


def first_fault(tree: object, bounds: Bounds = PREVIEW) -> str | None:
    return walked(tree, bounds)[1]


def _checked(texts: pd.Series, bounds: Bounds) -> pd.DataFrame:
    rows = []
    for text in texts:
        try:
            rows.append(walked(json.loads(text), bounds))
        except (ValueError, TypeError, RecursionError):
            rows.append((0, ":json"))
    return pd.DataFrame(rows, columns=["nodes", "fault"]).astype({"nodes": "int64"})


@arrow("nodes long, fault string")
def preview_tree(texts: pd.Series) -> pd.DataFrame:
    """nodes and the first fault of each tree (as JSON)."""
    return _checked(texts, PREVIEW)


@arrow("nodes long, fault string")
def illustration_tree(texts: pd.Series) -> pd.DataFrame:
    """The same under the bounds of an illustration."""
    return _checked(texts, ILLUSTRATION)
