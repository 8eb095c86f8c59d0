"""Column expressions: keys, tags, slugs, text filters, dates and URLs. No Python per row."""

from __future__ import annotations

from functools import reduce
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, functions as F

# Signs that a dash slug spells as words.
SIGN_WORDS = {
    ":": "colon", "/": "slash", "?": "question", "#": "hash", "[": "left-bracket", "]": "right-bracket",
    "@": "at", "!": "exclamation", "$": "dollar", "&": "and", "'": "single-quote", "(": "left-parenthesis",
    ")": "right-parenthesis", "*": "asterisk", "+": "plus", ",": "comma", ";": "semicolon", "=": "equal",
}
#: White space of any kind, for patterns of Java and Python alike.
WHITE = "[\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
STRFTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%y": "yy", "%j": "DDD", "%F": "yyyy-MM-dd", "%T": "HH:mm:ss", "%p": "a", "%I": "hh", "%e": "d"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def path_segments(path: Column | str) -> Column:
    """Segments of a slash path without empty ones."""
    return F.filter(F.split(col(path), "/"), lambda s: s != "")


def key_title(path: Column | str) -> Column:
    return F.element_at(path_segments(path), -1)


def key_ctx(path: Column | str) -> Column:
    """Context of a key path; null at the root."""
    s = path_segments(path)
    return F.when(F.size(s) > 1, F.slice(s, 1, F.size(s) - 1))


def path_title(path: Column | str) -> Column:
    """Title of the note at a path: the file's name without its ending."""
    return F.regexp_replace(key_title(path), r"\.md$", "")


def key_display(ctx: Column | str, title: Column | str) -> Column:
    return F.concat_ws("/", col(ctx), col(title))


def note_path(ctx: Column | str, title: Column | str) -> Column:
    return F.concat(key_display(ctx, title), F.lit(".md"))


def key_id(ctx: Column | str, title: Column | str) -> Column:
    """Key that keeps the border of context and title; a missing context equals an empty one, a null title an empty one."""
    return F.concat(F.array_join(F.transform(F.coalesce(col(ctx), F.array().cast("array<string>")), lambda x: F.concat(x, F.lit("\u0001"))), ""), F.coalesce(col(title), F.lit("")))


def tag_prefixes(tag: Column | str) -> Column:
    """The tag and all its ancestors, shortest first."""
    t = col(tag)
    return F.when(F.size(t) > 0, F.transform(F.sequence(F.lit(1), F.size(t)), lambda i: F.slice(t, 1, i))).otherwise(F.array().cast("array<array<string>>"))


def tag_leaf(tag: Column | str) -> Column:
    return F.element_at(col(tag), -1)


def tag_display(tag: Column | str) -> Column:
    return F.array_join(col(tag), "/")


def bounded(path: Column | str, depth: int = 3) -> Column:
    """Is a context or tag path non-empty and no deeper than ``depth``? For validation, never a filter."""
    return F.size(path_segments(path)).between(1, depth)


def slug_dash(text: Column | str) -> Column:
    spelt = reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(f"-{kv[1]}-")), SIGN_WORDS.items(), F.lower(F.regexp_replace(col(text), f"^{WHITE}+|{WHITE}+$", "")))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(spelt, f"{WHITE}+", "-"), "-+", "-"), "^-|-$", "")


def slug_heading(text: Column | str) -> Column:
    # letter by letter, so a sigma has no final form
    kept = F.regexp_replace(F.lower(F.replace(F.regexp_replace(col(text), f"(?:{WHITE}|-)+", "-"), F.lit("Σ"), F.lit("σ"))), r"[^\p{L}\p{N}-]+", "")
    return F.regexp_replace(F.regexp_replace(kept, "-+", "-"), "^-|-$", "")


def file_stem(ctx: Column | str, title: Column | str) -> Column:
    return F.concat_ws("/", F.transform(F.coalesce(col(ctx), F.array().cast("array<string>")), slug_dash), slug_dash(title))


def tag_slug(tag: Column | str) -> Column:
    return F.array_join(F.transform(col(tag), slug_dash), "/")


def base_url(url: Column | str) -> Column:
    return F.concat(F.regexp_replace(col(url), "/+$", ""), F.lit("/"))


def note_href(base: str, ctx: Column | str, title: Column | str, folder: str = "notes") -> Column:
    return F.concat(F.lit(f"{base.rstrip('/')}/{folder}/"), file_stem(ctx, title), F.lit(".html"))


def tag_href(base: str, tag: Column | str) -> Column:
    return F.concat(F.lit(base.rstrip("/") + "/tags/"), tag_slug(tag), F.lit(".html"))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "<[^>]*>", "")


def html_escape(text: Column | str) -> Column:
    out = col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def url_host(url: Column | str) -> Column:
    """Host of an absolute URL, null for anything else."""
    return F.try_parse_url(col(url), F.lit("HOST"))


def is_absolute_url(url: Column | str) -> Column:
    return F.try_parse_url(col(url), F.lit("PROTOCOL")).isNotNull()


def date_text(seconds: Column | str, fmt: str = "%Y-%m-%d", zone: str = "UTC") -> Column:
    """Unix seconds in a strftime format and a zone; an unknown format letter is an error."""
    try:
        ZoneInfo(zone)
    except Exception as e:
        raise ValueError(f"unknown time zone {zone!r}") from e
    out, i = "", 0
    while i < len(fmt):
        if fmt[i] == "%":
            if fmt[i : i + 2] == "%%":
                out += "'%'"
            elif fmt[i : i + 2] in STRFTIME:
                out += STRFTIME[fmt[i : i + 2]]
            else:
                raise ValueError(f"date format {fmt[i : i + 2]!r} is not supported")
            i += 2
        else:
            out += f"'{fmt[i]}'" if fmt[i].isalpha() else "''" if fmt[i] == "'" else fmt[i]
            i += 1
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(col(seconds)), zone), out)


def array_part(array: Column | str, start: int = 0, end: int | None = None, step: int = 1) -> Column:
    """Python-like slice: bounds from 0, negative ones from the end, clamped; empty where start >= end; null stays null."""
    if step < 1:
        raise ValueError("step must be at least 1")
    a = col(array)
    n = F.size(a)

    def bound(v: int | None) -> Column:
        return n if v is None else F.least(n, F.lit(v)) if v >= 0 else F.greatest(F.lit(0), n + v)

    lo, hi = bound(start), bound(end)
    return F.filter(a, lambda _, i: (i >= lo) & (i < hi) & ((i - lo) % step == 0))


def json_row(*columns: str) -> Column:
    """JSON object that keeps nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def envelope(rows: DataFrame) -> DataFrame:
    """One row: {results, count} of rows that fit it, in their order."""
    body = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("results"), F.count("*").alias("count"))
    return body.select(json_row("results", "count").alias("json"))


def json_value(value: Column | str) -> Column:
    """JSON of any value, a scalar too; null is null."""
    whole = F.to_json(F.struct(col(value).alias("v")), {"ignoreNullFields": "false"})
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def subsequence(keyword: str) -> str:
    """Regular expression for the characters of a keyword in order; linear, smart case (a capital makes it exact)."""
    fold = "" if any(c.isupper() for c in keyword) else "iu"

    def one(c: str) -> str:
        return "\\" + c if c in "\\^$.|?*+()[]{}-&~# " else c

    return f"(?s{fold})^" + "".join(f"[^{one(c)}]*+{one(c)}" for c in keyword)
