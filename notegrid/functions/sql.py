"""Functions of the engine for SQL: ``register(spark)`` makes them known to a session.

    SELECT n.title, r.* FROM notes n, LATERAL wiki_refs(n.md_text) r WHERE r.kind = 'link'

Scalar: wiki_slug(text), wiki_heading_slug(text), wiki_key(ctx, title), wiki_name(ctx, title), wiki_strip_tags(text),
wiki_escape(text), wiki_section(md, slug). Tables: wiki_refs(md), wiki_headings(md), wiki_tasks(md), wiki_code(md),
wiki_images(md).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession, functions as F

from notegrid.functions.expr import SIGN_WORDS, WHITE
from notegrid.functions.markdown import scan
from notegrid.operators.extract import section_text

#: Name, part of the scan, columns.
TABLES = {
    "wiki_refs": ("refs", "kind string, ctx array<string>, title string, heading string, alias string, line int"),
    "wiki_headings": ("headings", "level int, text string, line int, parent string, root boolean"),
    "wiki_tasks": ("tasks", "status string, text string, line int"),
    "wiki_code": ("code", "lang string, content string, line int"),
    "wiki_images": ("images", "url string"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _slug() -> str:
    trimmed = f"lower(regexp_replace(text, {_quoted(f'^{WHITE}+|{WHITE}+$')}, ''))"
    spelt = reduce(lambda c, kv: f"replace({c}, {_quoted(kv[0])}, {_quoted(f'-{kv[1]}-')})", SIGN_WORDS.items(), trimmed)
    return f"regexp_replace(regexp_replace(regexp_replace({spelt}, {_quoted(WHITE + '+')}, '-'), '-+', '-'), '^-|-$', '')"


def _heading_slug() -> str:
    kept = f"regexp_replace(lower(replace(regexp_replace(text, {_quoted(f'(?:{WHITE}|-)+')}, '-'), 'Σ', 'σ')), {_quoted('[^\\p{L}\\p{N}-]+')}, '')"
    return f"regexp_replace(regexp_replace({kept}, '-+', '-'), '^-|-$', '')"


SCALARS = {
    "wiki_slug(text STRING)": _slug(),
    "wiki_heading_slug(text STRING)": _heading_slug(),
    "wiki_key(ctx ARRAY<STRING>, title STRING)": "concat(array_join(transform(coalesce(ctx, array()), x -> concat(x, char(1))), ''), coalesce(title, ''))",
    "wiki_name(ctx ARRAY<STRING>, title STRING)": "concat_ws('/', ctx, title)",
    "wiki_strip_tags(text STRING)": "regexp_replace(text, '<[^>]*>', '')",
    "wiki_escape(text STRING)": "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')",
}


def _table(part: str, single: bool):
    class Rows:
        def eval(self, md: str):
            for row in getattr(scan(md, frozenset((part,))), part):
                yield (row,) if single else row

    return Rows


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; returns their names."""
    for head, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS STRING RETURN {body}")
    spark.udf.register("wiki_section", section_text)
    for name, (part, columns) in TABLES.items():
        spark.udtf.register(name, F.udtf(_table(part, part == "images"), returnType=columns))
    return [*(x.partition("(")[0] for x in SCALARS), "wiki_section", *TABLES]
