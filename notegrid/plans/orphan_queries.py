"""Orphan references of the wiki tables."""

from __future__ import annotations

from notegrid.operators import wikirefs
from notegrid.plans.registry import query
from notegrid.sources.tables import table

_WORDS = "trim(lower(regexp_replace({}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')))"
_BASE = f"""
n AS (SELECT note_id, coalesce(ctx, []) AS ctx, title, created_at, deleted_at, array_to_string(list_append(coalesce(ctx, []), title), '/') AS disp FROM wiki_notes),
l AS (SELECT DISTINCT note_id, strftime(created_at, '%Y-%m') AS period, unnest(links) AS target FROM wiki_notes),
r AS (SELECT DISTINCT ref_id, ctx_path AS ctx, title, {_WORDS.format('heading')} AS words, seen_at, strftime(seen_at, '%Y-%m') AS period, array_to_string(list_append(ctx_path, title), '/') AS target FROM wiki_link_refs),
h AS (SELECT DISTINCT n.ctx, n.title, {_WORDS.format('text')} AS words FROM headings h JOIN n ON n.note_id = h.note_id)
"""


@query("p5_found", f"""
WITH {_BASE}
SELECT DISTINCT 'links' AS src, period, note_id AS row_id, target FROM l WHERE target NOT IN (SELECT disp FROM n)
UNION
SELECT 'refs', period, ref_id, target FROM r
WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ctx = r.ctx AND n.title = r.title AND created_at <= seen_at AND (deleted_at IS NULL OR deleted_at > seen_at))
   OR (words IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.ctx = r.ctx AND h.title = r.title AND h.words = r.words))""")
def p5_found(spark, d):
    return wikirefs.missing(table(spark, d, "wiki_notes"), table(spark, d, "wiki_link_refs"), table(spark, d, "headings"))


@query("p5_report", f"""
WITH {_BASE},
o AS (SELECT 'notes' AS parent, period, target AS k FROM l WHERE target NOT IN (SELECT disp FROM n)
      UNION ALL SELECT 'refs', period, to_json([ctx, [title]])::VARCHAR FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.ctx = r.ctx AND n.title = r.title)
      UNION ALL SELECT 'headings', period, to_json([ctx, [title, words]])::VARCHAR FROM r WHERE words IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h WHERE h.ctx = r.ctx AND h.title = r.title AND h.words = r.words))
SELECT parent, period, count(*) AS orphans, count(DISTINCT k) AS keys FROM o GROUP BY 1, 2""")
def p5_report(spark, d):
    """Orphans by table and month."""
    return wikirefs.report(table(spark, d, "wiki_notes"), table(spark, d, "wiki_link_refs"), table(spark, d, "headings"))
