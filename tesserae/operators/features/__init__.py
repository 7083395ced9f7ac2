"""Classification of assets from what they are made of."""

from __future__ import annotations

from pyspark.sql import Column

from tesserae import vocab
from tesserae.functions.text import in_vocabulary

#: Properties that an analysis may name. Fixed values.
PROPERTIES = frozenset(
    "opacity transform transform-origin translate rotate scale filter clip-path mask mask-image width height max-height min-height top right bottom left inset color background background-color "
    "background-image background-position background-size background-clip border border-radius border-color border-width box-shadow text-shadow letter-spacing line-height font-size content display "
    "overflow perspective animation animation-name animation-duration animation-delay animation-iteration-count animation-timing-function transition transition-property transition-duration "
    "transition-delay fill stroke stroke-width stroke-dasharray stroke-dashoffset cx cy r d viewBox progress uv texture".split()
)
ANALYSIS = "asset_type string, effects array<string>, components array<string>, properties array<string>, techniques array<string>, use_cases array<string>, signals array<string>, valid boolean"


def ordered(found: set[str], vocabulary: tuple[str, ...]) -> list[str]:
    return [v for v in vocabulary if v in found]


def row(asset_type: str, effects=(), components=(), properties=(), techniques=(), use_cases=(), signals=(), valid: bool = True) -> tuple:
    """One analysis, its facets in the vocabularies' order."""
    return (
        asset_type, ordered(set(effects), vocab.EFFECTS), ordered(set(components), vocab.COMPONENTS), sorted(set(properties) & PROPERTIES),
        ordered(set(techniques), vocab.TECHNIQUES), ordered(set(use_cases), vocab.USE_CASES), list(dict.fromkeys(signals))[:96], valid,
    )


def in_order(found: Column, vocabulary: tuple[str, ...]) -> Column:
    return in_vocabulary(found, vocabulary)
