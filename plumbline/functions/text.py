"""Text functions, as Column expressions. Only Unicode repair leaves the JVM, and only for texts that need it."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.catalog import MOJIBAKE, MOJIBAKE_LEADS

#: White space as Python's regular expressions know it; Java's own class lacks the later ones.
SPACE = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The same characters.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
#: Line ends as ``str.splitlines`` knows them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Texts of characters that neither NFKC nor the repair of encodings ever touches, alone or side by side.
SETTLED = r"^[\x00-\x7f\u00a1\u00ab\u00bb\u00bf-\u00c1\u00c4-\u00e1\u00e3-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e]*$"
DASHES = "\u2013\u2014"


def repair_python(text: str) -> str:
    """Byte order marks dropped, broken encodings repaired, NFKC, line ends unified."""
    value = text.replace("\ufeff", "")
    if any(lead in value for lead in MOJIBAKE_LEADS):
        try:
            value = value.encode("latin1").decode("utf-8")
        except UnicodeError:
            pass
    for broken, right in MOJIBAKE.items():
        value = value.replace(broken, right)
    return _lines(unicodedata.normalize("NFKC", value))


def _lines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


@F.pandas_udf(T.StringType())
def _repair(texts: pd.Series) -> pd.Series:
    return texts.map(repair_python, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: _lines(unicodedata.normalize("NFKC", t)), na_action="ignore")


def _line_ends(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def _only_where_needed(text: Column, function) -> Column:
    """A null goes to Python for each settled text, so that its characters do not."""
    text = F.coalesce(text, F.lit(""))
    return F.coalesce(function(F.when(~text.rlike(SETTLED), text)), _line_ends(text))


def repair(text: Column) -> Column:
    """``repair_python``; null becomes empty."""
    return _only_where_needed(text, _repair)


def nfkc(text: Column) -> Column:
    """NFKC and line ends, without repair of encodings; null becomes empty."""
    return _only_where_needed(text, _nfkc)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def compact(c: Column) -> Column:
    """Runs of white space become one blank, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def clean_inline(text: Column, repaired: bool = False) -> Column:
    """Repaired, NUL as blank, blanks and tabs collapsed, at most one empty line, stripped. ``repaired``: the text already is."""
    value = text if repaired else repair(text)
    return strip(_squeezed(F.regexp_replace(F.translate(value, "\x00", " "), r"[ \t]+", " ")))


def normalized(text: Column, repaired: bool = False) -> Column:
    """What rules are matched on: clean, lower case, plain dashes, single blanks."""
    return compact(F.translate(F.lower(clean_inline(text, repaired)), DASHES, "--"))


def clean_prompt(text: Column) -> Column:
    return strip(_squeezed(F.replace(repair(text), F.lit("\u2022"), F.lit("- "))))


def claim_text(text: Column, repaired: bool = False) -> Column:
    """NFKC, bullets on lines of their own, blanks and empty lines squeezed, stripped; no repair, dashes stay."""
    value = text if repaired else nfkc(text)
    value = F.regexp_replace(F.replace(value, F.lit("\u2022"), F.lit("\n- ")), r"[ \t]+", " ")
    return strip(_squeezed(value))


def lines(text: Column) -> Column:
    """Lines as ``str.splitlines`` cuts them; empty text has none, a final line end adds none."""
    cut = F.split(F.coalesce(text, F.lit("")), LINE_END)
    last = F.element_at(cut, -1)
    return F.when(last == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def without_adjacent(items: Column) -> Column:
    """Items that are not empty and differ from the last kept one."""
    full = F.filter(items, lambda x: x != "")
    before = F.concat(F.array(F.lit("")), full)
    return F.filter(F.zip_with(full, before, lambda x, b: F.when(x != b, x)), lambda x: x.isNotNull())


def distinct_compact(items: Column) -> Column:
    """Compact items, empty ones dropped, the first of equals kept."""
    return F.array_distinct(F.filter(F.transform(items, compact), lambda x: x != ""))


def slug(name: Column, fallback: str = "model") -> Column:
    """File-name form: other characters than letters, digits, dot, dash and underscore become underscores."""
    plain = F.regexp_replace(F.coalesce(name, F.lit("")), r"[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.trim(plain, F.lit("_")), F.lit("")), F.lit(fallback))


def file_stem(case_id: Column, model: Column, prompt_id: Column) -> Column:
    return F.concat_ws("__", case_id, slug(model), prompt_id)


def digest(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def parse_bool(value: Column) -> Column:
    """True for true, 1 and yes in any case, else false; never null."""
    return F.coalesce(strip(F.lower(value.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def parse_optional_bool(value: Column) -> Column:
    """As ``parse_bool``, but null for empty, none and null."""
    plain = F.coalesce(strip(F.lower(value.cast("string"))), F.lit(""))
    return F.when(~plain.isin("", "none", "null"), plain.isin("true", "1", "yes"))


def safe_int(value: Column) -> Column:
    """Truncated toward zero; zero for what is no finite number."""
    number = value.cast("string").try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 9.2e18), number.cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def escape_html(text: Column) -> Column:
    value = F.coalesce(text.cast("string"), F.lit(""))
    for plain, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        value = F.replace(value, F.lit(plain), F.lit(safe))
    return value


def sorted_json(values: Column, order: Sequence[str]) -> Column:
    """A map of booleans as JSON with sorted keys and blanks after commas and colons."""
    parts = [F.concat(F.lit(f'"{k}": '), F.coalesce(F.try_element_at(values, F.lit(k)), F.lit(False)).cast("string")) for k in sorted(order)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
