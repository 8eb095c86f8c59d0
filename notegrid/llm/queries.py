"""Queries of the operations on text collections and their SQL, where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from notegrid.llm import leaks, neardup, pack, quality, respell, split, terms, together
from notegrid.sources.tables import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


WORDS_SQL = "regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+')"
_SETS_SQL = f"""
w AS (SELECT note_id, {WORDS_SQL.format(text="concat(title, chr(10), md_text)")} AS w FROM (SELECT DISTINCT note_id, coalesce(title, '') AS title, coalesce(md_text, '') AS md_text FROM wiki_notes)),
g AS (SELECT DISTINCT note_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
n AS (SELECT note_id, count(*) AS n FROM g GROUP BY 1),
c AS (SELECT a.note_id AS a, b.note_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.note_id < b.note_id GROUP BY 1, 2),
pairs AS (SELECT a, b, c = na.n AND c = nb.n AS same FROM c JOIN n na ON na.note_id = a JOIN n nb ON nb.note_id = b WHERE c * 10 >= (na.n + nb.n - c) * 6)
"""


@query("p1_found", f"WITH {_SETS_SQL} SELECT a AS note_id_a, b AS note_id_b FROM pairs")
def p1_found(spark, d) -> DataFrame:
    return neardup.expand(*neardup.near_duplicates(table(spark, d, "wiki_notes")))


@query("p1_groups", f"""
WITH RECURSIVE {_SETS_SQL},
m AS (SELECT n.note_id, least(n.note_id, min(CASE WHEN same THEN a END)) AS class_id FROM n LEFT JOIN pairs ON b = n.note_id GROUP BY n.note_id),
k AS (SELECT class_id, count(*) AS copies FROM m GROUP BY 1),
l AS (SELECT a, b FROM pairs JOIN k x ON x.class_id = a JOIN k y ON y.class_id = b WHERE NOT same),
e AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l),
r AS (SELECT class_id AS x, class_id AS y FROM k UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT note_id, m.class_id, (SELECT min(y) FROM r WHERE r.x = m.class_id) AS group_id, copies, (SELECT count(*) FROM e WHERE e.x = m.class_id) AS links FROM m JOIN k ON k.class_id = m.class_id""")
def p1_groups(spark, d) -> DataFrame:
    return neardup.groups(table(spark, d, "wiki_notes"))


@query("p2_found", """
WITH n AS (SELECT note_id, md_text FROM wiki_notes WHERE length(md_text) > 4000),
h AS (SELECT DISTINCT h.note_id, h.line, length(md_text) AS size,
        CASE WHEN h.line = 1 THEN 0 ELSE length(array_to_string(string_split(md_text, chr(10))[1:h.line - 1], chr(10))) + 1 END AS pos
      FROM headings h JOIN n ON n.note_id = h.note_id),
s AS (SELECT note_id, line, lead(pos, 1, size) OVER (PARTITION BY note_id ORDER BY line) - pos AS own FROM h)
SELECT note_id, 0 AS line FROM n UNION ALL SELECT note_id, line FROM s WHERE own > 4000""")
def p2_found(spark, d) -> DataFrame:
    return split.oversized(table(spark, d, "wiki_notes"), table(spark, d, "headings"))


@query("p2_pieces")
def p2_pieces(spark, d) -> DataFrame:
    return split.split_oversized(table(spark, d, "wiki_notes"), table(spark, d, "headings")).drop("sections")


@query("p2_rebuilt", "SELECT note_id, md5(md_text) AS digest, 0 AS over, 0 AS unled FROM wiki_notes WHERE length(md_text) > 4000")
def p2_rebuilt(spark, d) -> DataFrame:
    """The pieces of each note put together again, and whether they keep the limit and the overlap."""
    return split.rebuilt(split.split_oversized(table(spark, d, "wiki_notes"), table(spark, d, "headings")))


@query("p3_found")
def p3_found(spark, d) -> DataFrame:
    return respell.odd_spellings(*respell.wiki_rows(table(spark, d, "wiki_notes"), table(spark, d, "wiki_link_refs"), table(spark, d, "tag_refs")))


@query("p3_spellings")
def p3_spellings(spark, d) -> DataFrame:
    rows, _ = respell.wiki_rows(table(spark, d, "wiki_notes"), table(spark, d, "wiki_link_refs"), table(spark, d, "tag_refs"))
    return respell.respell(rows.select("value")).where("value <> plain")


_PAIR_SQL = """
WITH x AS (SELECT 'tag' AS kind, note_id, unnest(list_distinct(tags)) AS item FROM wiki_notes
           UNION ALL SELECT 'link', note_id, unnest(list_distinct(links)) FROM wiki_notes),
c AS (SELECT kind, item, count(*) AS n_item FROM x GROUP BY ALL),
p AS (SELECT a.kind, a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM x a JOIN x b ON a.kind = b.kind AND a.note_id = b.note_id AND a.item < b.item GROUP BY ALL HAVING count(*) >= 5),
t AS (SELECT count(*) AS n FROM wiki_notes)
SELECT {columns} FROM p JOIN c ca ON ca.kind = p.kind AND ca.item = p.item_a JOIN c cb ON cb.kind = p.kind AND cb.item = p.item_b, t {where}
"""


@query("p4_found", _PAIR_SQL.format(columns="p.kind, item_a, item_b", where="WHERE n_ab::HUGEINT * n >= 3::HUGEINT * ca.n_item * cb.n_item"))
def p4_found(spark, d) -> DataFrame:
    return together.above_chance(together.together(table(spark, d, "wiki_notes"), {"tag": "tags", "link": "links"})).select("kind", "item_a", "item_b")


@query("p4_pairs", _PAIR_SQL.format(columns="p.kind, item_a, item_b, n_ab, ca.n_item AS n_a, cb.n_item AS n_b, n, round(n_ab * n::DOUBLE / ca.n_item / cb.n_item, 6) AS lift", where=""))
def p4_pairs(spark, d) -> DataFrame:
    return together.together(table(spark, d, "wiki_notes"), {"tag": "tags", "link": "links"}).withColumn("lift", F.round("lift", 6))


_TERM_SQL = "x AS (SELECT t AS term, count(*) AS occurrences, count(DISTINCT note_id) AS records FROM (SELECT note_id, unnest({items}) AS t FROM wiki_notes) WHERE t IS NOT NULL GROUP BY 1), n AS (SELECT count(*) AS n FROM wiki_notes)"
_LATEST_SQL = "l AS (SELECT title, arg_max(coalesce(backlinks_count, -1), (listed_at, list_id)) AS stated, count(DISTINCT list_id) AS listed FROM tag_counts WHERE title IS NOT NULL GROUP BY 1)"


@query("p6_found", f"""
WITH {_TERM_SQL.format(items='tags')}, {_LATEST_SQL}
SELECT term AS title, 'rare' AS mark FROM x WHERE records <= 2
UNION ALL SELECT term, 'common' FROM x, n WHERE records * 10 > n
UNION ALL SELECT term, 'stale' FROM x JOIN l ON l.title = x.term WHERE stated = -1 OR stated <> records""")
def p6_found(spark, d) -> DataFrame:
    return terms.tag_marks(table(spark, d, "wiki_notes"), table(spark, d, "tag_counts"))


@query("p6_links", f"""
WITH {_TERM_SQL.format(items='links')}
SELECT term, occurrences, records, n AS records_all, round(records / n, 9) AS share,
       CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.1 * n THEN 'common' ELSE 'useful' END AS usefulness FROM x, n""")
def p6_links(spark, d) -> DataFrame:
    return terms.marked(table(spark, d, "wiki_notes"), "links").withColumn("share", F.round("share", 9))


@query("p6_listings", f"""
WITH {_TERM_SQL.format(items='tags')}, {_LATEST_SQL}
SELECT coalesce(x.term, l.title) AS title, coalesce(records, 0) AS records, nullif(stated, -1) AS stated, coalesce(listed, 0) AS listed
FROM x FULL JOIN l ON l.title = x.term""")
def p6_listings(spark, d) -> DataFrame:
    return terms.listing_audit(table(spark, d, "wiki_notes"), table(spark, d, "tag_counts"))


_TOKENS_SQL = "len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}]+'))"


@query("p7_found", f"SELECT doc_id FROM documents WHERE {_TOKENS_SQL} > 1024")
def p7_found(spark, d) -> DataFrame:
    return pack.larger_than_container(pack.pack(pack.sizes(table(spark, d, "documents"))))


@query("p7_audit", f"SELECT doc_id, n AS tokens, (n + 1023) // 1024 AS pieces, 0 AS wrong FROM (SELECT doc_id, {_TOKENS_SQL} AS n FROM documents) WHERE n > 0")
def p7_audit(spark, d) -> DataFrame:
    """What the packing holds of each text, and how many of its pieces lie in wrongly filled containers."""
    return pack.audit(pack.pack(pack.sizes(table(spark, d, "documents"))))


@query("p7_containers")
def p7_containers(spark, d) -> DataFrame:
    """Containers by the byte-level tokenizer; its file's path is the Spark setting notegrid.tokenizer where set."""
    path = spark.conf.get("notegrid.tokenizer", "/opt/tokenizers/byte_bpe_50k.json")
    return pack.pack(pack.sizes(table(spark, d, "documents"), count=pack.tokenizer_tokens(path)))


@query("p8_found", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL.format(text="text")} AS w FROM documents), v AS (SELECT item_id, {WORDS_SQL.format(text="text")} AS w FROM eval_items),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 12], ' ') AS g FROM w, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i)),
h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM v, LATERAL (SELECT unnest(range(1, len(w) - 11)) AS i))
SELECT DISTINCT doc_id, item_id FROM g JOIN h ON g.g = h.g""")
def p8_found(spark, d) -> DataFrame:
    return leaks.find(leaks.index(table(spark, d, "documents")), table(spark, d, "eval_items")).select("doc_id", "item_id")


@query("p8_leaks")
def p8_leaks(spark, d) -> DataFrame:
    """Runs of eight words on, and proximity matches of any runs."""
    found = leaks.find(leaks.index(table(spark, d, "documents")), table(spark, d, "eval_items"), run=8, proximity=True)
    kind = F.when(F.col("longest") >= leaks.RUN, "exact").when(F.col("near") >= leaks.RUN, "proximity").otherwise("fragment")
    return found.withColumn("kind", kind)


@query("p9_found")
def p9_found(spark, d) -> DataFrame:
    return quality.not_prose(quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words")))


_BLANK = "\\s\\p{Z}\\x{0B}\\x{1C}-\\x{1F}\\x{85}"


@query("p9_statistics", f"""
WITH c AS (SELECT list(DISTINCT word) AS c FROM common_words WHERE word IS NOT NULL),
x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
y AS (SELECT doc_id, len(regexp_extract_all(t, '[^{_BLANK}]+')) AS pieces, length(regexp_replace(t, '[{_BLANK}]', '', 'g')) AS ink, length(regexp_replace(t, '[\\p{{L}}\\p{{N}}{_BLANK}]', '', 'g')) AS signs,
        list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^{_BLANK}]')) AS l, {WORDS_SQL.format(text="t")} AS w FROM x),
z AS (SELECT doc_id, pieces, ink / greatest(1, pieces) AS mean_length, signs / greatest(1, ink) AS symbol_ratio, len(list_filter(l, lambda x: regexp_matches(x, '[.!?][{_BLANK}]*$'))) / greatest(1, len(l)) AS ended_lines,
        len(list_filter(w, lambda x: list_contains(c, x))) / greatest(1, len(w)) AS common_share, len(w) AS words, len(l) AS lines FROM y, c)
SELECT doc_id, pieces, round(mean_length, 9) AS mean_length, round(symbol_ratio, 9) AS symbol_ratio, round(ended_lines, 9) AS ended_lines, round(common_share, 9) AS common_share, words, lines,
  (pieces < 30)::INT + (mean_length < 3.5 OR mean_length > 8.5)::INT + (symbol_ratio > 0.2)::INT + (ended_lines < 0.4)::INT + (common_share < 0.15)::INT AS flags FROM z""")
def p9_statistics(spark, d) -> DataFrame:
    rows = quality.measures(table(spark, d, "documents"), table(spark, d, "common_words"))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean_length", "symbol_ratio", "ended_lines", "common_share")})


@query("p9_labels")
def p9_labels(spark, d) -> DataFrame:
    """The measures, and the share of each text in lines of prose, lists, tables and junk."""
    return quality.statistics(table(spark, d, "documents"), table(spark, d, "common_words"))
