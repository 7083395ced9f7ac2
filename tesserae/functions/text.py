"""Text expressions: tokens, folding, normal forms, canonical JSON."""

from __future__ import annotations

import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import arrow

#: Letters with a mark and the letters without it, for texts that hold no others.
MARKED, PLAIN = "àáâäãåçèéêëìíîïñòóôöõùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
#: Usual signs that ``fold_text`` leaves as they are, whatever stands beside them: ASCII, signs and ligatures of Latin, punctuation, Han.
UNMARKED = r"\x00-\x7F\xA0-\xBF\xD7\xF7\xC6\xD0\xD8\xDE\xDF\xE6\xF0\xF8\xFE\u2010-\u2027\u2030-\u205E\u4E00-\u9FFF"
#: An index token, but for its case and its marks.
TOKEN = r"([\p{L}\p{N}\p{Co}]+)"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, as an index sees them; accents kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def plain_fold(text: Column) -> Column:
    """Without accents, for Latin text in composed form; ``fold`` takes any text."""
    return F.translate(text, MARKED, PLAIN)


def fold_text(text: str) -> str:
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c)))


@arrow("string")
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(fold_text, na_action="ignore")


@arrow("string")
def nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@arrow("string")
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(str.casefold, na_action="ignore")


def ascii_lower(text: Column) -> Column:
    """The order key of case-insensitive titles: only A-Z are folded."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def index_words(text: str) -> list[str]:
    """Tokens of a query word as the index has them: marks dropped, any other sign separates."""
    out, run = [], []
    for c in unicodedata.normalize("NFD", text.lower()):
        if unicodedata.combining(c):
            continue
        if unicodedata.category(c)[0] in "LN" or unicodedata.category(c) == "Co":
            run.append(c)
        elif run:
            out.append("".join(run))
            run = []
    return [unicodedata.normalize("NFC", w) for w in (*out, *(["".join(run)] if run else []))]


def one_space(text: Column) -> Column:
    """White space and comments become one blank outside quoted literals."""
    quoted = r"""("(?:\\[\s\S]|[^"\\])*"|'(?:\\[\s\S]|[^'\\])*')"""
    return F.trim(F.regexp_replace(text, quoted + r"|(?:/\*[\s\S]*?\*/|\s)+", "$1 ").substr(F.lit(1), F.lit(2_000_000_000)))


def capped(texts: Column, chars: int) -> Column:
    """The strings of an array joined by blanks, cut after so many characters."""
    return F.substring(F.array_join(texts, " "), 1, chars)


def canonical_json(value) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@arrow("string")
def canonical(texts: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks; null where it is none."""

    def one(text: str) -> str | None:
        try:
            return canonical_json(json.loads(text))
        except ValueError:
            return None

    return texts.map(one, na_action="ignore")


def numeric_skeleton(text: Column) -> Column:
    return F.regexp_replace(text, r"[-+]?(?:\d*\.\d+|\d+)", "#")


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16LE")) / 2).cast("long")


def shingles(words: Column, width: int) -> Column:
    """Runs of ``width`` neighbouring elements, joined by blanks; none if there are too few."""
    # ``words`` is only named outside of lambdas: inside, it would be made anew for each place
    n = F.greatest(F.size(words) - width + 1, F.lit(0))
    out = F.slice(words, 1, n)
    for k in range(2, width + 1):
        out = F.zip_with(out, F.slice(words, k, n), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def in_vocabulary(found: Column, vocabulary: tuple[str, ...]) -> Column:
    """The found values in the vocabulary's order."""
    # an intersection keeps the order of its first side, and looks at the second once
    return F.array_intersect(F.array(*(F.lit(v) for v in vocabulary)), F.coalesce(found, F.array().cast("array<string>")))


def formula_guarded(cell: Column) -> Column:
    """A spreadsheet must not run a cell: a quote goes before what starts, but for white space (Python's), like a formula."""
    return F.when(cell.rlike(r"^(?U)[\s\x1c-\x1f]*[=+\-@]"), F.concat(F.lit("'"), cell)).otherwise(cell)


def terminal_safe(text: str) -> str:
    """Controls except newline and tab as hexadecimal escapes."""
    return "".join(f"\\x{ord(c):02x}" if (ord(c) < 32 and c not in "\n\t") or 127 <= ord(c) < 160 else c for c in text)


def terminal_json(value) -> str:
    """JSON text in which no control beyond ASCII is left as it is (those within, JSON escapes itself)."""
    return "".join(f"\\u{ord(c):04x}" if 127 <= ord(c) < 160 else c for c in json.dumps(value, ensure_ascii=False))


@arrow("string")
def for_terminal(texts: pd.Series) -> pd.Series:
    return texts.map(terminal_safe, na_action="ignore")
