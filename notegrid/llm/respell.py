"""One consistent spelling for text that looks the same.

Distinct values are exploded to positioned code points; a table of all
decompositions and one of all marks, of the letters of the three scripts and of
36 shapes that these share (both of a size fixed by Unicode and this module) are
broadcast-joined; combining marks are ordered by class inside their
segment; segments are recomposed and the strings rebuilt. Look-alike letters
are settled by word: a word that mixes scripts takes the one script to which
letters without a twin belong.

Each value gets ``plain`` (its plain spelling) and ``skeleton`` (the same with
every look-alike as its Latin twin, so equal for all strings that look alike).
Printable ASCII is its own plain spelling and skeleton. Joiners and non-joiners stay between characters of a
writing that they shape (Arabic, Indic, emoji); all else that is invisible goes. Nulls stay null, the
empty string stays empty, a value of nothing but invisible characters becomes
empty. Case is kept.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from notegrid.plans.scratch import written

# Letters of equal shape in Latin, Cyrillic and Greek script ("." where a script has none).
LATIN = "ABCEHIJKMNOPSTXYZQVWacdehijlopqsvwxy"
CYRILLIC = "АВСЕНІЈКМ.ОРЅТХУ.ԚѴԜасԁеһіјӏорԛѕѵԝху"
GREEK = "ΑΒ.ΕΗΙ.ΚΜΝΟΡ.ΤΧΥΖ....ϲ...ιϳ.ορ..ν.χ."
#: Tags of compatibility decompositions that only change width, shape or joining.
SHAPES = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>"}
#: Writing in which a joiner or non-joiner between two characters changes what is seen: there it stays, elsewhere it goes.
_SCRIPTS = ("Arabic", "Syriac", "Mongolian", "Devanagari", "Bengali", "Gurmukhi", "Gujarati", "Oriya", "Tamil", "Telugu", "Kannada", "Malayalam", "Sinhala")
_JOINED = "[" + "".join(rf"\p{{Is{x}}}" for x in _SCRIPTS) + r"\p{So}\x{FE0F}\x{1F3FB}-\x{1F3FF}]"
_BLANK = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}


def decomposition(c: str) -> str | None:
    """What a character is spelt with; None if with itself."""
    kind = unicodedata.category(c)
    if c in "\u200c\u200d":  # those that do nothing are gone by then
        return None
    if kind == "Cf" or ord(c) in _BLANK:
        return ""
    if kind == "Zs" or c in "\t\n\r\x0b\x0c\x85  ":
        return " " if c != " " else None
    if 0xAC00 <= ord(c) <= 0xD7A3:  # composed by rule, and so left whole
        return None
    own = unicodedata.decomposition(c)
    if not own:
        return None
    if own[0] != "<":
        full = unicodedata.normalize("NFD", c)
    elif own.split()[0] in SHAPES:
        full = unicodedata.normalize("NFKD", c)
        if own.startswith("<compat>") and not all(unicodedata.category(x)[0] in "LM" for x in full):
            return None
    else:
        return None
    return full if full != c else None


@cache
def _rows() -> tuple[list[tuple], list[tuple]]:
    """Rows of ``tables``; made once in a process."""
    parts, props = [], []
    twins = {}
    for row in zip(LATIN, CYRILLIC, GREEK):
        for x in row:
            if x != ".":
                twins[x] = [y if y != "." else None for y in row]
    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n < 0xE000 or 0x3400 <= n < 0xA000 or 0x20000 <= n < 0x2F800 or 0x30000 <= n < 0xE0000 or n >= 0xF0000:
            continue  # surrogates, ideographs without decomposition, private use
        c = chr(n)
        if (d := decomposition(c)) is not None:
            parts.append((c, list(d)))
    for n in [*range(0x41, 0x530), *range(0x1C80, 0x2000), *range(0x2C60, 0x2C80), *range(0x2DE0, 0x2E00), *range(0xA640, 0xA800), *range(0xAB30, 0xAB70)]:
        c = chr(n)
        if not c.isalpha():
            continue
        script = next((s for s in ("LATIN", "CYRILLIC", "GREEK") if unicodedata.name(c, "").startswith(s)), None)
        if script:
            props.append((c, 0, script[0], c not in twins, *twins.get(c, [None] * 3)))
    for n in range(0x300, 0x1E950):
        if (k := unicodedata.combining(chr(n))) and chr(n) not in {p[0] for p in props[-1:]}:
            props.append((chr(n), k, None, False, None, None, None))
    return parts, props


def tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(c, parts) of decompositions and (c, class, script, lone, latin, cyrillic, greek) of marks and letters."""
    parts, props = _rows()
    return (
        spark.createDataFrame(pd.DataFrame(parts, columns=["c", "parts"]), "c string, parts array<string>"),
        spark.createDataFrame(pd.DataFrame(props, columns=["c", "class", "script", "lone", "latin", "cyrillic", "greek"]), "c string, class int, script string, lone boolean, latin string, cyrillic string, greek string"),
    )


@F.pandas_udf(T.StringType())
def recompose(s: pd.Series) -> pd.Series:
    """A starter with its ordered marks as one character where Unicode has one."""
    return s.map(lambda x: x if x is None or len(x) < 2 else unicodedata.normalize("NFC", x))


def simple(c: Column) -> Column:
    """True for printable ASCII, which is plain as it is."""
    return ~c.rlike(r"[^ -~]")


def without_idle_joiners(c: Column) -> Column:
    """The text without joiners and non-joiners that shape nothing; two noncharacters stand for the others meanwhile."""
    for joiner, mark in ("\u200c\ufdd0", "\u200d\ufdd1"):
        c = F.regexp_replace(c, f"({_JOINED}){joiner}(?={_JOINED})", f"$1{mark}")
    return F.translate(F.translate(c, "\u200c\u200d", ""), "\ufdd0\ufdd1", "\u200c\u200d")


def respell(values: DataFrame, column: str = "value") -> DataFrame:
    """(value, plain, skeleton) of each distinct non-null value."""
    spark = values.sparkSession
    all_values = values.select(F.col(column).cast("string").alias("value")).where("value is not null").distinct()
    easy = all_values.where(simple(F.col("value"))).select("value", F.col("value").alias("plain"), F.col("value").alias("skeleton"))
    odd = written(all_values.where(~simple(F.col("value"))).withColumn("id", F.monotonically_increasing_id()), "odd")
    parts, props = (F.broadcast(x) for x in tables(spark))
    points = odd.select("id", F.posexplode(F.regexp_extract_all(without_idle_joiners(F.col("value")), F.lit(r"(?s)(.)"), F.lit(1))).alias("pos", "c"))
    split = points.join(parts, "c", "left").select("id", "pos", F.posexplode(F.coalesce("parts", F.array("c"))).alias("sub", "c"))
    known = split.join(props, "c", "left").withColumn("class", F.coalesce("class", F.lit(0)))
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = known.repartition(parts_n, "id").withColumn("starts", (F.col("class") == 0) & ~F.col("c").between("ᅠ", "ᇿ"))
    along = W.partitionBy("id").orderBy("pos", "sub")
    known = known.withColumn("inside", ~F.col("starts") | F.col("c").rlike(r"^[\p{L}\p{N}\p{M}]"))
    known = known.withColumns({"seg": F.sum(F.col("starts").cast("long")).over(along), "word": F.sum((~F.col("inside")).cast("long")).over(along)})
    in_word = W.partitionBy("id", "word")
    n = {s: F.sum((F.col("script") == s).cast("long")) for s in "LCG"}
    lone = {s: F.sum(((F.col("script") == s) & F.col("lone")).cast("long")) for s in "LCG"}
    known = known.withColumns({f"n{s}": F.coalesce(n[s].over(in_word), F.lit(0)) for s in "LCG"} | {f"u{s}": F.coalesce(lone[s].over(in_word), F.lit(0)) for s in "LCG"})
    mixed = sum((F.col(f"n{s}") > 0).cast("int") for s in "LCG") > 1
    owners = sum((F.col(f"u{s}") > 0).cast("int") for s in "LCG")
    most = F.greatest("nL", "nC", "nG")
    target = F.when(mixed & (owners == 1), F.when(F.col("uL") > 0, "L").when(F.col("uC") > 0, "C").otherwise("G")).when(
        mixed & (owners == 0), F.when(F.col("nL") == most, "L").when(F.col("nC") == most, "C").otherwise("G"))
    known = known.withColumn("target", target).select(
        "id", "seg", F.struct("class", "pos", "sub", F.coalesce(F.when(F.col("target") == "L", F.col("latin")).when(F.col("target") == "C", F.col("cyrillic")).when(F.col("target") == "G", F.col("greek")), "c").alias("p"), F.coalesce("latin", "c").alias("s")).alias("x"))
    joined = known.groupBy("id", "seg").agg(F.sort_array(F.collect_list("x")).alias("x"))
    joined = joined.select("id", "seg", recompose(F.array_join("x.p", "")).alias("p"), recompose(F.array_join("x.s", "")).alias("s"))
    built = joined.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seg", "p", "s"))).alias("x")).select("id", F.array_join("x.p", "").alias("plain"), F.array_join("x.s", "").alias("skeleton"))
    hard = odd.join(built, "id", "left").select("value", F.coalesce("plain", F.lit("")).alias("plain"), F.coalesce("skeleton", F.lit("")).alias("skeleton"))
    return easy.unionByName(hard)


def odd_spellings(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Rows (field, space, row_id, value) that look like a plainly spelt name (space, value) but differ from it.

    A name is plainly spelt if it is its own plain spelling. Result: distinct (field, row_id, plain).
    """
    spelt = written(respell(rows.select("value").unionByName(names.select("value"))), "spelt")
    known = names.where("value is not null").distinct().join(spelt, "value").where("value = plain").select("space", F.col("value").alias("name"), "skeleton")
    values = rows.where("value is not null").select("space", "value").distinct().join(spelt, "value")
    # a plain row is a case only if a word of it is wholly of twins, and a Latin name has its look
    cases = values.join(known, ["space", "skeleton"]).where("value <> name and (value <> plain or name = skeleton)")
    best = cases.groupBy("space", "value").agg(F.min(F.struct((F.col("name") != F.col("plain")).alias("far"), "name")).alias("b")).select("space", "value", F.col("b.name").alias("plain"))
    return rows.join(best, ["space", "value"]).select("field", "row_id", "plain").distinct()


def wiki_rows(notes: DataFrame, links: DataFrame, tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows and names of the three name columns of a wiki."""
    def pick(df: DataFrame, field: str, space: str, row_id: str, value: Column) -> DataFrame:
        return df.select(F.lit(field).alias("field"), F.lit(space).alias("space"), F.col(row_id).cast("bigint").alias("row_id"), value.alias("value"))

    path = F.array_join("path", "/")
    rows = pick(notes, "note_title", "note", "note_id", F.col("title")).unionByName(pick(links, "link_title", "note", "ref_id", F.col("title"))).unionByName(pick(tags, "tag_path", "tag", "tag_ref_id", path))
    names = notes.select(F.lit("note").alias("space"), F.col("title").alias("value")).unionByName(tags.select(F.lit("tag").alias("space"), path.alias("value")))
    return rows, names
