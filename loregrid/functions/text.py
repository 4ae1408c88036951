"""Text functions as column expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Invisible characters, injection patterns and what replaces them.
ZERO_WIDTH = r"[\x{200b}-\x{200f}\x{feff}\x{00ad}\x{180e}\x{fff9}-\x{fffb}\x{2060}-\x{2064}]"
REMOVED = "[已移除]"
INJECTIONS = [
    r"忽略\s*\x{200b}?\s*(?:之前的|以上|一切|所有)\s*\x{200b}?\s*限制",
    r"(?i)ignore\s*\x{200b}?\s*(?:previous|all|above)\s*\x{200b}?\s*instructions",
    r"(?i)dan\s*模式|developer\s*mode|越狱|jailbreak",
    r"(?is)<script[^>]*>.*?</script>",
    r"\{\{.*?\}\}",
    r"eval\s*\(|exec\s*\(",
    r"alert\s*\(|prompt\s*\(|confirm\s*\(",
    r"eval\s*atob\s*\(|fromCharCode\s*\(",
]
#: A text in which a pattern is found holds, in lower case, one of these. None shares a character with REMOVED, so what replaces one pattern makes none of them.
NEEDED = [("忽略",), ("ignore",), ("模式", "developer", "越狱", "jailbreak"), ("<script",), ("{{",), ("eval", "exec"), ("alert", "prompt", "confirm"), ("atob", "fromcharcode")]
ENCODED = r"(?i)(?:base64|c2Fwc2VjcmV0|bj9zaGlmdA==|ignore)[a-zA-Z0-9+/=]{10,}"
PLACEHOLDER_VERSION = r"(?i)^\$\{.*\}|^.*-SNAPSHOT$|^$"
CJK = r"[\x{4e00}-\x{9fff}\x{3400}-\x{4dbf}\x{3000}-\x{303f}\x{ff00}-\x{ffef}]"


def _folds() -> tuple[str, str]:
    """Characters that decompose into one letter and combining marks, with the marks themselves at the end, and those letters: for translate(), which deletes what has no counterpart."""
    accented, plain = [], []
    marks = [chr(c) for c in range(0x300, 0x370)]
    for c in map(chr, range(0xC0, 0x2000)):
        first, *rest = unicodedata.normalize("NFD", c)
        if rest and first.isalpha() and all(m in marks for m in rest):
            accented.append(c)
            plain.append(first)
    return "".join(accented + marks), "".join(plain)


ACCENTED, PLAIN = _folds()


def tokens(text: Column, fold_accents: bool = False) -> Column:
    """Lower-cased runs of letters and numbers; with folded accents a letter's combining marks don't end a run."""
    low = F.lower(text)
    return F.filter(F.split(F.translate(low, ACCENTED, PLAIN) if fold_accents else low, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def words(text: Column) -> Column:
    """Runs beside white space, lower-cased."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def pipeline_tokens(text: Column) -> Column:
    """Two characters to a token."""
    return (F.length(text) / 2).cast("int")


def prompt_tokens(text: Column) -> Column:
    """CJK characters at 1.5 and others at 2.5 to a token."""
    cjk = F.regexp_count(text, F.lit(CJK))
    return F.floor(cjk / 1.5 + (F.length(text) - cjk) / 2.5).cast("int")


def occurrences(text: Column, part: Column) -> Column:
    """How often part stands in text without overlap; an empty part as often as there are gaps between characters."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) == 0, F.length(text) + 1).otherwise(n).cast("int")


def stripped(text: Column) -> Column:
    """Without white space (by Unicode) at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def chunk_id(*fields: Column) -> Column:
    """Twelve hexadecimal digits of the fields joined by colons."""
    return F.substring(F.md5(F.concat_ws(":", *fields).cast("binary")), 1, 12)


@F.arrow_udf(T.StringType())
def nfkc(text: pa.Array) -> pa.Array:
    """Compatibility normal form; Spark has no function of its own for it."""
    return pc.utf8_normalize(text, form="NFKC")


# Not folded into an expression that normalises again: Spark would leave the outer call of two unevaluated.
nfkc = nfkc.asNondeterministic()


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is made once however often f names it."""
    return F.transform(F.array(value), f)[0]


def _without(text: Column, pattern: str, found: Column) -> Column:
    return _bound(text, lambda t: F.when(found, F.regexp_replace(t, pattern, REMOVED)).otherwise(t))


def without_injections(text: Column) -> Column:
    """Every injection pattern in turn replaced by a marker. A pattern is sought only in texts that hold what it needs."""

    def cleaned(t: Column, low: Column) -> Column:
        for pattern, needed in zip(INJECTIONS, NEEDED):
            t = _without(t, pattern, functools.reduce(Column.__or__, [F.contains(low, F.lit(n)) for n in needed]))
        return t

    return _bound(text, lambda t: _bound(F.lower(t), lambda low: cleaned(t, low)))


def sanitized(text: Column, normalize: bool = True) -> Column:
    """Invisible characters removed, normalised, injections replaced."""
    text = F.regexp_replace(text, ZERO_WIDTH, "")
    return without_injections(nfkc(text) if normalize else text)


def carries_encoded(text: Column) -> Column:
    """Whether encoded payloads stand in the text or in its URL-decoded form."""
    return F.coalesce(text.rlike(ENCODED) | F.coalesce(F.try_url_decode(text), F.lit("")).rlike(ENCODED), F.lit(False))


def literal_map(values: dict, default) -> callable:
    """A look-up of a string column in a small table of constants."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return lambda key: F.coalesce(table[key], F.lit(default))
