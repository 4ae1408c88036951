"""SQL table functions for LATERAL: the parts of a text as rows, from SQL alone. They are SQL themselves, so no Python runs for them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..schemas import PARAGRAPH_CHARS
from .ingest import API_SECTIONS, ENDPOINT, ENTRY, TITLE

NAMES = ("api_entries_of", "paragraphs_of", "packed_paragraphs_of")


def _stripped(text: str) -> str:
    return rf"regexp_replace({text}, r'(?U)^\s+|\s+$', '')"


def register(spark: SparkSession) -> None:
    """Makes the functions in the session, for `FROM table, LATERAL function(column)`:

    api_entries_of(text): entry_no, entry_title, entry, http_method, url_path as ingest.api_entries(). paragraphs_of(text, separator): ord, content of the paragraphs that aren't empty.
    packed_paragraphs_of(text, separator): ord, content as ingest.packed_paragraphs(). Null texts have no rows.
    """
    first, second = (f"regexp_instr(content, r'{p}')" for p in API_SECTIONS)
    part = f"SELECT CASE WHEN {first} > 0 THEN substring(content, {first}, length(content)) WHEN {second} > 0 THEN substring(content, {second}, length(content)) END AS part"
    entries = f"SELECT entry_no, {_stripped('raw')} AS entry FROM (SELECT posexplode(split(part, r'{ENTRY}')) AS (entry_no, raw) FROM ({part}))"
    body = _stripped(r"regexp_replace(entry, r'^[^\n]*\n?', '')")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION api_entries_of(content STRING) RETURNS TABLE(entry_no INT, entry_title STRING, entry STRING, http_method STRING, url_path STRING)
        RETURN SELECT entry_no, {_stripped(f"regexp_extract(entry, r'{TITLE}', 1)")}, entry, upper(regexp_extract(entry, r'{ENDPOINT}', 1)), regexp_extract(entry, r'{ENDPOINT}', 2)
        FROM ({entries}) WHERE {body} <> ''""")
    held = f"filter(transform(split(content, separator), p -> {_stripped('p')}), p -> p <> '')"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION paragraphs_of(content STRING, separator STRING) RETURNS TABLE(ord INT, content STRING) RETURN SELECT posexplode({held}) AS (ord, content)")
    more = "CASE WHEN s.open = '' THEN p ELSE concat(s.open, '\\n\\n', p) END"
    full = f"length({more}) >= {PARAGRAPH_CHARS}"
    packed = f"""aggregate({held}, named_struct('done', CAST(array() AS ARRAY<STRING>), 'open', ''),
        (s, p) -> named_struct('done', CASE WHEN {full} THEN concat(s.done, array({more})) ELSE s.done END, 'open', CASE WHEN {full} THEN '' ELSE {more} END),
        s -> CASE WHEN s.open = '' THEN s.done ELSE concat(s.done, array(s.open)) END)"""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION packed_paragraphs_of(content STRING, separator STRING) RETURNS TABLE(ord INT, content STRING) RETURN SELECT posexplode({packed}) AS (ord, content)")
