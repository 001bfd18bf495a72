"""Comment blanking. A scanner over characters is no SQL expression, so these are Arrow UDFs; lengths and line numbers
of the text stay as they are."""

from __future__ import annotations

import ast
import io
import re
import tokenize

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

_C = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`|//[^\n]*|/\*.*?(?:\*/|\Z)', re.S)
_HASH = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|#[^\n]*')


def _blank(found: str) -> str:
    return re.sub(r"[^\n]", " ", found)


def blank_c(text: str | None) -> str | None:
    """Blanks // and /* */ outside of strings; every character keeps its line and column."""
    return None if text is None else _C.sub(lambda m: _blank(m[0]) if m[0][0] == "/" else m[0], text)


def blank_hash(text: str | None) -> str | None:
    return None if text is None else _HASH.sub(lambda m: _blank(m[0]) if m[0][0] == "#" else m[0], text)


def blank_by_language(text: str | None, lang: str | None) -> str | None:
    return blank_hash(text) if lang in ("py", "gd", "sh", "yaml") else blank_c(text)


def python_noncode_lines(text: str | None) -> list[int]:
    """Lines of Python that hold only strings or comments; none where it doesn't parse."""
    try:
        tree = ast.parse(text or "")
        marks = {t.start[0] for t in tokenize.generate_tokens(io.StringIO(text or "").readline) if t.type == tokenize.COMMENT and t.line.strip().startswith("#")}
    except (SyntaxError, ValueError, tokenize.TokenError):
        return []
    for node in ast.walk(tree):
        if isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            marks.update(range(node.lineno, node.end_lineno + 1))
    return sorted(marks)


@F.pandas_udf(StringType())
def strip_comments(text: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([blank_by_language(t, x) for t, x in zip(text, lang)], dtype=object)


@F.pandas_udf(ArrayType(IntegerType()))
def noncode_lines(text: pd.Series) -> pd.Series:
    return pd.Series([python_noncode_lines(t) for t in text], dtype=object)


def regex_skeleton(pattern: str) -> str:
    """The literal residue of a pattern: without look-arounds, classes, groups and quantifiers."""
    out = re.sub(r"\(\?<?[=!](?:[^()\\]|\\.)*\)", "", pattern)
    out = re.sub(r"\[(?:\\.|[^\]\\])*\]", "", out)
    out = re.sub(r"\\[wWdDsSbB]|\(\?[:iPms][^)]*|[(){}|*+?^$.]|\{\d*,?\d*\}", "", out)
    return out.replace("\\", "")
