"""Operators on text collections against brute force, with nulls, empty and long texts, ties, repeats, empty tables and clashing names."""

import random
import re
import shutil
import unicodedata
from collections import Counter
from itertools import combinations, product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from notegrid.llm import leaks, neardup, pack, quality, respell, split, terms, text, together

WORD = re.compile(r"[^\W_]+")


def words(t):
    return [w.lower() for w in WORD.findall(t or "")]


def some_text(rng, n):
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


VOCABULARY = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "s", "lo", "ma")]


# --- text ---------------------------------------------------------------------


def test_words_match_a_plain_reading():
    texts = ["", None, "Ünï_x ﬁ 12a--b", "A" * 50, "日本 ガタ　x\n", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + "z", "é é"]
    texts.append("ΟΔΟΣ Σ ΑΣΑ 1Σ ΣΣ, οδος")
    h, doc, start, end = text.words(*text.points(texts))
    got = [[] for _ in texts]
    cp, begin = text.points(texts)
    for d, a, b in zip(doc, start, end):
        got[d].append("".join(map(chr, cp[a:b])).lower())
    assert got == [words(t) for t in texts]
    assert h[list(doc).index(3)] == np.uint64(text.hash_word("a" * 50))
    assert text.hash_word("ΟΔΟΣ") == text.hash_word("οδος") != text.hash_word("οδοσ") and text.hash_word("1Σ") == text.hash_word("1σ")


def test_blocks_cover_all_and_keep_long_texts_whole():
    assert list(text.blocks(["a" * 10, None, "b" * 100, "c"], 20)) == [(0, 2), (2, 3), (3, 4)]
    assert list(text.blocks([])) == []


# --- 1 near duplicates --------------------------------------------------------


def near_pairs(notes):
    sets = {}
    for i, title, body in notes:
        w = words(f"{title or ''}\n{body or ''}")
        if i is not None and len(w) > 2:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def edited(rng, t):
    w = t.split()
    for _ in range(rng.randrange(1, 4)):
        w[rng.randrange(len(w))] = "changed"
    return " ".join(w)


NOTES = "note_id bigint, title string, md_text string, id string, rep string, s string, route string"


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = some_text(rng, rng.randrange(20, 120))
        rows.append((len(rows), f"T{g}", base))
        rows += [(len(rows) + k, f"T{g}", edited(rng, base)) for k in range(rng.randrange(0, 4))]
    rows += [(1000 + k, "Same", rows[0][2]) for k in range(5)] + [(2000, None, None), (2001, "", ""), (2002, "two words", None), (2003, None, some_text(rng, 20000)), (None, "x y z", "x y z")]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], NOTES)
    want = near_pairs(rows)
    got = [tuple(r) for r in neardup.expand(*neardup.near_duplicates(df)).collect()]
    assert set(got) == want and len(got) == len(want) > 50
    monkeypatch.setattr(neardup, "CELL", 2)
    monkeypatch.setattr(neardup, "DEPTH", 1)  # tops of more than two notes are cut into cells
    assert {tuple(r) for r in neardup.expand(*neardup.near_duplicates(df), block=2).collect()} == want
    monkeypatch.setattr(neardup, "DEPTH", 2)  # they grow once, then cells
    grown = {tuple(r) for r in neardup.expand(*neardup.near_duplicates(df)).collect()}
    assert grown <= want and len(grown) > 0.98 * len(want)
    per = {r["note_id"]: r for r in neardup.groups(df).collect()}
    assert set(per) == {i for i, t, b in rows if i is not None and len(words(f"{t or ''} {b or ''}")) > 2}
    parent = {i: i for i in per}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {i: r["group_id"] for i, r in per.items()} == {i: root(i) for i in per}
    assert per[1000]["copies"] == 5


def test_crowded_tops_lose_no_pair(spark, monkeypatch):
    rng = random.Random(8)
    shared, rows = some_text(rng, 70).split(), []
    for g in range(12):
        base = shared + [f"{rng.choice(VOCABULARY)}{g}" for _ in range(34)]
        rows += [(3 * g + c, None, " ".join(base[: len(base) - k] + [f"new{g}x{x}" for x in range(k)])) for c, k in enumerate((0, 13, 22))]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], NOTES)
    monkeypatch.setattr(neardup, "CELL", 8)
    assert {tuple(r) for r in neardup.expand(*neardup.near_duplicates(df)).collect()} == near_pairs(rows)
    links = neardup.near_duplicates(df, threshold=0.45)[1]  # below the usual threshold too
    sets = {i: set(zip(w, w[1:], w[2:])) for i, _, t in rows for w in [t.split()]}
    assert {(r["a"], r["b"]) for r in links.collect()} == {(a, b) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.45 * len(sets[a] | sets[b])}


def test_every_pair_at_the_threshold_shares_its_tops():
    rng, share = np.random.default_rng(4), neardup.Fraction("0.6")
    for _ in range(300):
        n = int(rng.integers(3, 200))
        pool = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64) * np.uint64(2)
        keep = int(rng.integers(n * 3 // 4, n + 1))
        a, b = np.sort(pool[:n]), np.sort(np.append(pool[:keep], pool[n : n + int(rng.integers(0, n))]))
        shared = len(np.intersect1d(a, b))
        if shared * 10 < 6 * (len(a) + len(b) - shared):
            continue
        i, j = neardup.trie_pairs(np.zeros(2, np.int64), neardup._sketch(np.append(a, b), np.array([0, n]), 4), size=np.array([n, len(b)]), share=share)
        assert len(i) == 1
        tops = [x[: neardup._first(np.array(len(x)), share)] for x in (a, b)]  # in order of hashes
        need = neardup._pairs(np.arange(2), np.array([n, len(b)]), share, i, j, np.ones(1, np.int64))["need"][0]
        assert len(np.intersect1d(*tops)) >= max(1, need)


def test_a_repeated_id_counts_once(spark):
    rng = random.Random(12)
    texts = [some_text(rng, 40) for _ in range(3)]
    rows = [(1, "a", texts[0]), (1, "a", texts[0]), (2, "a", texts[0]), (3, "b", texts[1]), (3, "b", texts[2]), (4, "b", texts[1]), (5, "b", texts[2])]
    df = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], NOTES).coalesce(1)
    got = [tuple(r) for r in neardup.expand(*neardup.near_duplicates(df)).collect()]
    assert sorted(got) == [(1, 2), (3, 4)] or sorted(got) == [(1, 2), (3, 5)]
    assert len(neardup.groups(df).collect()) == 5


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], NOTES)
    assert neardup.expand(*neardup.near_duplicates(df)).count() == 0 and neardup.groups(df).count() == 0


def test_trie_equals_all_pairs():
    rng = np.random.default_rng(1)
    sketch = rng.integers(0, 1 << 63, (300, 4), dtype=np.uint64)
    for _ in range(9):
        sketch[100:200] = (sketch[:100] if _ == 0 else sketch[100:200]) ^ (np.uint64(1) << rng.integers(0, 63, (100, 4)).astype(np.uint64))
    sketch[200:220] = sketch[5]
    top = np.arange(300) % 3
    top[100:200] = top[:100]
    top[200:220] = 2
    for turn in (0, 20):
        count = {}
        i, j = neardup.trie_pairs(top, sketch, turn, count=count)
        first = [(int(x) << turn | int(x) >> (64 - turn)) & (1 << 64) - 1 for x in sketch[:, 0]]

        def near(a, b):
            along = [((first[a] ^ first[b]) >> 63 - d).bit_count() <= neardup.LIMITS[d] for d in (7, 15, 23, 31, 47, 63)]
            errors = np.cumsum(np.bitwise_count(sketch[a] ^ sketch[b]))
            return all(along) and all(errors <= neardup.WORDS)

        got = {tuple(sorted(x)) for x in zip(i.tolist(), j.tolist())}
        wide = {(a, b) for a, b in combinations(range(300), 2) if top[a] == top[b] and near(a, b)}
        tight = {(a, b) for a, b in wide if all(((first[a] ^ first[b]) >> 63 - d).bit_count() <= neardup.LIMITS[d] for d in range(64))}
        assert tight <= got <= wide and len(got) == len(i) > 200
        assert count["past"] < count["leaves"] < count["below"]


def test_similar_pairs_stay_below_the_limits():
    rng = np.random.default_rng(2)
    walks = (rng.random((20000, 64)) < 0.2).cumsum(axis=1)
    assert (walks <= neardup.LIMITS).all(axis=1).mean() > 0.95 and (walks[:, -1] <= neardup.LIMITS[-1]).mean() > 0.999
    assert ((rng.random((20000, 64)) < 0.5).cumsum(axis=1) <= neardup.LIMITS).all(axis=1).mean() < 0.02


def test_components_run_until_nothing_changes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "range", lambda n: range(1), raising=False)  # a limit of rounds, if it comes back, is one
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a bigint, b bigint")
    assert {tuple(r) for r in neardup.components(links).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# --- 2 splitting --------------------------------------------------------------


@pytest.mark.parametrize("limit, overlap", [(100, 0), (100, 20), (50, 49), (7, 1)])
def test_pieces_cover_the_text_under_the_limit(limit, overlap):
    rng = random.Random(limit + overlap)
    for n in range(30):
        t = "".join(rng.choice(["ab", " ", ". ", "\n", "\r\n", "\n\n", "# h\n", "x" * rng.randrange(1, 150)]) for _ in range(rng.randrange(1, 120)))
        cut = split.pieces(t, {1: 1, 4: 2}, limit, overlap)
        assert cut[0][0] == 0 and cut[-1][1] == len(t) and all(a[1] == b[0] for a, b in zip(cut, cut[1:]))
        if len(t) > limit:
            assert all(b - max(0, a - overlap) <= limit for a, b in cut)
            if limit - overlap > 2:
                assert all(t[a - 1 : a + 1] != "\r\n" for a, _ in cut[1:])


def test_cuts_fall_at_headings_first():
    t = "# A\n" + "word " * 60 + "\n# B\n" + "word " * 60
    assert [t[a : a + 3] for a, _ in split.pieces(t, {1: 1, 3: 1}, 400, 10)] == ["# A", "# B"]


def test_split_table(spark):
    long = "# A\n" + "x y. " * 1000 + "\n## B\nshort\n"
    notes = spark.createDataFrame([(1, long, "t"), (2, "a" * 4000, "t"), (3, None, "t"), (4, "", "t"), (5, "a" * 4001, "t"), (None, long, "t")], "note_id bigint, md_text string, heads string")
    heads = spark.createDataFrame([(1, 1, 1, "z"), (1, 1, 1, "z"), (1, 3, 2, "z"), (1, 99, 2, "z"), (1, None, None, None), (None, 1, 1, "z"), (2, 1, 1, "z")], "note_id bigint, line int, level int, piece string")
    assert sorted(map(tuple, split.oversized(notes, heads).collect())) == [(1, 0), (1, 1), (5, 0)]
    out = split.split_oversized(notes, heads).where("note_id = 1").orderBy("piece").collect()
    assert "".join(r["text"][r["start"] - r["lead"] :] for r in out) == long and all(len(r["text"]) <= 4000 for r in out)
    assert split.oversized(notes.limit(0), heads.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split.split_oversized(notes, heads, 10, 10)


# --- 3 respelling -------------------------------------------------------------


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("Ｎａｒｒｏｗ　ｐ", "Narrow p"), ("ma​rk­", "mark"), ("été", "été"), ("oﬃce", "office"), ("ﾀｸﾞ", "タグ"), ("Жуpнал", "Журнал"), ("mаrk x", "mark x"),
        ("ậ", "ậ"), ("ậ", "ậ"), ("λόγoς", "λόγος"), ("straße", "straße"), ("сор", "сор"), ("​", ""), ("한국", unicodedata.normalize("NFC", "한국")), ("😀é", "😀é"), ("x" * 5000 + "é", "x" * 5000 + "é"),
    ],
)
def test_plain_spelling(spark, odd, plain):
    r = respell.respell(spark.createDataFrame([(odd,), (odd,), (None,), ("",)], "value string")).where("value <> ''").collect()
    assert [(x["value"], x["plain"]) for x in r] == [(odd, plain)]


@pytest.mark.parametrize(
    "odd, plain",
    [
        ("ma\u200crk", "mark"), ("ma\u200drk\u200d", "mark"), ("\u200d", ""), ("می\u200cخواهم", "می\u200cخواهم"), ("x\u200cمی", "xمی"), ("क्\u200dष", "क्\u200dष"),
        ("\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\u200d\U0001f469\u200d\U0001f467"), ("a\u200b\u2060\u00adb", "ab"),
    ],
)
def test_joiners_stay_where_they_shape(spark, odd, plain):
    r = respell.respell(spark.createDataFrame([(odd,)], "value string")).collect()
    assert [(x["value"], x["plain"]) for x in r] == [(odd, plain)]


def test_odd_spellings(spark):
    notes = spark.createDataFrame([(1, "Mark", "p"), (2, "Mаrk", "p"), (3, "MARK", "p"), (4, None, None), (5, "", "p"), (6, "Mark", "p"), (7, "Lоst", "p"), (8, "сор", "p"), (9, "cop", "p")], "note_id bigint, title string, plain string")
    links = spark.createDataFrame([(1, "Ｍａｒｋ"), (1, "Ｍａｒｋ"), (2, "Mark"), (None, None)], "ref_id bigint, title string")
    tags = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "​b"]), (3, None), (4, ["Mаrk"])], "tag_ref_id bigint, path array<string>")
    got = sorted(map(tuple, respell.odd_spellings(*respell.wiki_rows(notes, links, tags)).collect()))
    assert got == [("link_title", 1, "Mark"), ("note_title", 2, "Mark"), ("note_title", 8, "cop"), ("tag_path", 2, "a/b")]
    empty = respell.wiki_rows(notes.limit(0), links.limit(0), tags.limit(0))
    assert respell.odd_spellings(*empty).count() == 0


# --- 4 items together ---------------------------------------------------------


@pytest.mark.parametrize("heavy, block", [(1, 2000), (256, 2000), (4, 2), (1, 1)])
def test_pairs(spark, heavy, block, monkeypatch):
    monkeypatch.setattr(together, "HEAVY", heavy)
    monkeypatch.setattr(together, "BLOCK", block)
    monkeypatch.setattr(together, "HELD", 50)
    rng = random.Random(heavy)
    items = [f"i{k}" for k in range(30)]
    rows = [(k, [rng.choice(items[: rng.choice((3, 30))]) for _ in range(rng.randrange(0, 8))] + [None], "x") for k in range(300)] + [(999, None, "x"), (1000, [], "x")]
    df = spark.createDataFrame(rows, "rec bigint, tags array<string>, kind string")
    got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in together.together(df, {"tag": "tags"}, 3).collect()}
    sets = [set(t or []) - {None} for _, t, _ in rows]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in combinations(sorted(s), 2))
    assert got == {p: (n, one[p[0]], one[p[1]], len(rows)) for p, n in two.items() if n >= 3} and len(got) > 50
    far = together.above_chance(together.together(df, {"tag": "tags"}, 3)).count()
    assert far == sum(n >= 3 and n * len(rows) >= 3 * one[p[0]] * one[p[1]] for p, n in two.items())
    assert together.together(df.limit(0), {"tag": "tags"}).count() == 0


# --- 6 term frequency ---------------------------------------------------------


def test_trie_counts(monkeypatch):
    rng = random.Random(5)
    trie, want = terms.Trie(), Counter()
    for _ in range(5000):
        t = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 9)))
        trie.add(t, 2, 1)
        want[t] += 1
    def flat(t):
        return {p + x: (n, m) for p, xs, ns, ms in t.containers() for x, n, m in zip(xs, ns, ms)}

    counts = {t: (2 * n, n) for t, n in want.items()}
    assert flat(trie) == counts and trie.size == len(want)
    assert [p + x for p, xs, _, _ in trie.containers() for x in xs] == sorted(want) and any(p for p, *_ in trie.containers())
    for most in (1, 7, 48, 10**6):  # subtrees of tries that burst elsewhere
        monkeypatch.setattr(terms, "BURST", most)
        other, both = terms.Trie(), terms.Trie()
        for t in want:
            other.add(t, 1, 0)
        for part in (trie, other, trie):
            for subtree in part.containers():
                both.merge(*subtree)
        assert flat(both) == {t: (2 * n + 1, 2 * m) for t, (n, m) in counts.items()} and both.size == len(want)


def test_subtrees_are_sent_by_adaptive_prefixes():
    full = {"", "a", "ab"}
    assert [terms.route(t, full) for t in ("", "b", "bc", "a", "ac", "acd", "ab", "abx")] == [None, "b", "b", None, "ac", "ac", None, "abx"]
    pdf = pd.DataFrame([("", ["", "a", "ab", "abc", "abd", "b"], list(range(6)), [1] * 6), ("ac", ["", "x"], [7, 8], [1, 1])], columns=["prefix", "suffixes", "occurrences", "records"])
    for c in ("suffixes", "occurrences", "records"):
        pdf[c] = pdf[c].map(lambda x: np.array(x, object if isinstance(x[0], str) else np.int64))
    out = pd.concat(terms._routed([pdf], full))
    assert [(r.route, [r.prefix + x for x in r.suffixes]) for r in out.itertuples()] == [("", [""]), ("a", ["a"]), ("ab", ["ab"]), ("abc", ["abc"]), ("abd", ["abd"]), ("b", ["b"]), ("ac", ["ac", "acx"])]


def test_term_counts(spark, monkeypatch):
    monkeypatch.setattr(terms, "HELD", 3)
    rows = [(1, ["a", "a", "b", None, ""], "x"), (2, ["a"], "x"), (3, None, "x"), (4, [], "x"), (5, ["a", "c"], "x")]
    df = spark.createDataFrame(rows, "note_id bigint, tags array<string>, term string").repartition(3)
    assert sorted(map(tuple, terms.term_counts(df, "tags").collect())) == [("", 1, 1), ("a", 4, 3), ("b", 1, 1), ("c", 1, 1)]
    monkeypatch.setattr(terms, "BURST", 2)
    rng = random.Random(6)
    many = ["".join(rng.choice("abc") for _ in range(rng.randrange(0, 6))) for _ in range(3000)]
    wide = spark.createDataFrame([(many[k : k + 5],) for k in range(0, 3000, 5)], "tags array<string>").repartition(5)
    assert {r["term"]: r["occurrences"] for r in terms.term_counts(wide, "tags").collect()} == Counter(many)
    listed = spark.createDataFrame([(1, "a", 9, 1), (2, "a", 3, 2), (3, "b", None, 1), (3, "b", None, 1), (4, "z", 1, 1), (5, None, 1, 1)], "list_id bigint, title string, backlinks_count bigint, listed_at bigint")
    got = sorted(map(tuple, terms.tag_marks(df, listed).collect()))
    assert got == [("", "common"), ("", "rare"), ("a", "common"), ("b", "common"), ("b", "rare"), ("b", "stale"), ("c", "common"), ("c", "rare")]
    assert {tuple(r) for r in terms.listing_audit(df, listed).collect()} == {("", 1, None, 0), ("a", 3, 3, 2), ("b", 1, None, 1), ("c", 1, None, 0), ("z", 0, 1, 1)}
    assert terms.marked(df.limit(0), "tags").count() == 0 and terms.tag_marks(df.limit(0), listed).count() == 0


# --- 7 packing ----------------------------------------------------------------


def loads(number, size):
    load = Counter()
    for b, s in zip(number, size):
        load[int(b)] += s
    return load


def test_fill_is_valid_and_tight():
    rng = random.Random(9)
    size = [min(1024, max(1, int(rng.expovariate(1 / 250)))) for _ in range(2000)]
    load = loads(pack.fill(size), size)
    assert max(load.values()) <= 1024 and len(load) <= 1.01 * sum(size) / 1024 + 1
    assert len(pack.fill([])) == 0 and len(set(pack.fill([1024] * 3))) == 3 and len(set(pack.fill([600] * 3))) == 3
    assert len(set(pack.fill([6, 5, 5, 4], 10))) == 2


def test_search_empties_containers_and_ends_where_no_step_raises_the_squares():
    rng = random.Random(10)
    for n in range(30):
        size = [rng.randrange(150, 400) for _ in range(rng.randrange(1, 120))] + ([1] * 50 if n == 0 else [])
        start = pack.best_fit(size)
        search = pack.Search(size, start, 1024)
        squares = [sum(x * x for x in search.load.tolist())]
        step = search._apply

        def counted(*a):
            done = step(*a)
            squares.append(sum(x * x for x in search.load.tolist()))
            return done

        search._apply = counted
        load = loads(search.run(), size)
        assert max(load.values()) <= 1024 and sum(load.values()) == sum(size) and sorted(load.values()) == sorted(x for x in search.load.tolist() if x)
        assert all(a < b for a, b in zip(squares, squares[1:]))
        assert len(load) <= len(set(start.tolist()))
        if len(load) > search.least:  # no move, no swap is left: by trying all
            fill, own = search.load, {b: [k for k in range(len(size)) if search.number[k] == b] for b in load}
            own = {b: [k for k in range(len(size)) if search.number[k] == b] for b in set(search.number.tolist())}
            for a in own:
                for b in own:
                    if a != b and fill[a] < 1024 and fill[b] < 1024:
                        give = [[k] for k in own[a]] + [list(p) for p in combinations(own[a], 2)]
                        get = [[], *[[k] for k in own[b]]]
                        for x in give:
                            for y in get:
                                d = sum(size[k] for k in x) - sum(size[k] for k in y)
                                if (len(x) == 1 or y) and d > 0 and fill[b] + d <= 1024:
                                    assert fill[b] + d <= fill[a]
    hard = [rng.randrange(200, 500) for _ in range(1500)]
    assert len(set(pack.fill(hard))) < len(set(pack.best_fit(hard)))


def test_pack(spark):
    docs = [(1, "a " * 3000), (2, "b_c!? d"), (3, ""), (4, None), (5, "x " * 1024), (6, "  \n"), (None, "q " * 5000), (7, "é" * 100000)]
    df = spark.createDataFrame([(*r, "z") for r in docs], "doc_id bigint, text string, tokens string")
    out = pack.pack(pack.sizes(df), cell=2).collect()
    per = Counter()
    for r in out:
        per[r["doc_id"]] += r["tokens"]
    assert per == {1: 3000, 2: 3, 5: 1024, 7: 1}
    assert [r["tokens"] for r in sorted(out, key=lambda r: r["piece"]) if r["doc_id"] == 1] == [1024, 1024, 952]
    load = Counter()
    for r in out:
        load[r["container"]] += r["tokens"]
    assert all(load[r["container"]] == r["fill"] <= 1024 for r in out)
    assert [r[0] for r in pack.larger_than_container(pack.pack(pack.sizes(df))).collect()] == [1]
    assert pack.pack(pack.sizes(df.limit(0))).count() == 0


def test_run_tokens_match_a_plain_reading():
    rng = random.Random(2)
    texts = ["".join(rng.choice("aÉ1_ .,-\n é日") for _ in range(60)) for _ in range(50)]
    assert pack.run_tokens(texts).tolist() == [len(re.findall(r"\w+|[^\w\s]+", t)) for t in texts]


# --- 8 leaks ------------------------------------------------------------------


def test_leaks(spark):
    rng = random.Random(4)
    items = [(k, some_text(rng, 40)) for k in range(20)] + [(50, "too short to be found"), (51, None), (None, "x"), (3, None)]
    docs, item_of = [], dict(items[:20])
    for k in range(200):
        w = some_text(rng, rng.randrange(0, 200)).split()
        if k % 3 == 0:
            src = item_of[rng.randrange(20)].split()
            n, at = rng.choice((12, 13, 14, 40)), rng.randrange(0, 20)
            w[len(w) // 2 : len(w) // 2] = [x.upper() + rng.choice(("", ",", " _")) for x in src[at : at + n]]
        docs.append((k, " ".join(w)))
    docs += [(500, None), (501, ""), (None, items[0][1]), (502, (items[0][1] + " ") * 300), (503, items[0][1]), (503, items[0][1])]
    grams = {}
    for i, t in items[:20]:
        w = words(t)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = {(d, i) for d, t in docs if d is not None for w in [words(t)] for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    df = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, item_id string")
    ev = spark.createDataFrame([i for i in items if i != (3, None)], "item_id bigint, text string")
    index = leaks.index(df)
    for most in (2000, 7):
        got = [tuple(r) for r in leaks.find(index, ev, most=most).select("doc_id", "item_id").collect()]
        assert set(got) == want and len(got) == len(want) > 20
    whole = leaks.find(index, ev).where("doc_id = 503").collect()[0]
    assert (whole["longest"], whole["item_words"]) == (40, 40)
    assert leaks.find(leaks.index(df.limit(0)), ev).count() == 0 and leaks.find(index, ev.limit(0)).count() == 0


def test_other_items_need_no_second_scan(spark, tmp_path, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(leaks, "SHARD_CHARS", 500)
    texts = [(k, some_text(rng, rng.randrange(13, 60))) for k in range(80)]
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(str(tmp_path / "docs"))
    index = leaks.index(spark.read.parquet(str(tmp_path / "docs")))
    shutil.rmtree(tmp_path / "docs")
    for own in (texts[:40], texts[40:]):
        items = spark.createDataFrame(own, "item_id bigint, text string")
        assert {tuple(r) for r in leaks.find(index, items).select("doc_id", "item_id").collect()} == {(k, k) for k, _ in own}
    rows = leaks.postings_of(index).where("term is not null").groupBy("doc_id").agg(F.sum(F.size("positions")).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in rows} == {k: len(words(t)) for k, t in texts}


def near_plain(d, t, most=26):
    """Most words of a stretch of the item that stand at the same distances in the text; by trying all."""
    equal = {g: [0 <= q + g < len(d) and d[q + g] == t[q] for q in range(len(t))] for g in range(-len(t), len(d))}
    return max((sum(e[k : k + most]) for e in equal.values() for k in range(len(t))), default=0)


@pytest.mark.parametrize("chunk", [2_000_000, 50])
def test_edited_passages_are_proximity_matches(spark, monkeypatch, chunk):
    monkeypatch.setattr(leaks, "CHUNK", chunk)
    rng = random.Random(8)
    vocabulary = ["the", "of", *(f"w{i}" for i in range(40))]
    items = [(k, [f"i{k}x{rng.randrange(30)}" if rng.random() < 0.4 else rng.choice(vocabulary) for _ in range(n)]) for k, n in enumerate((40, 30, 20, 13, 12))]
    texts = []
    for k in range(60):
        w = list(items[k % 5][1])
        for at in range(k % 7, len(w), 2 + k % 4):
            w[at : at + 1] = [["edited"], [*w[at : at + 1], "more"], []][k // 5 % 3]
        if k % 11 == 0:
            rng.shuffle(w)
        texts.append([rng.choice(vocabulary) for _ in range(rng.randrange(30))] + w + [rng.choice(vocabulary) for _ in range(rng.randrange(30))])
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id bigint, text string")
    found = leaks.find(leaks.index(docs), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"), run=8, proximity=True).collect()
    got = {(r["doc_id"], r["item_id"]): r["near"] for r in found if r["longest"] < 8}
    want = {(d, i): n for d, w in enumerate(texts) for i, t in items if (n := near_plain(w, t)) >= 13}
    runs = {(r["doc_id"], r["item_id"]) for r in found if r["longest"] >= 8}
    assert got == {k: n for k, n in want.items() if k not in runs} and len(got) >= 10
    assert all(r["near"] >= want.get((r["doc_id"], r["item_id"]), 0) for r in found)


def test_runs_of_other_diagonals_do_not_break_a_chain():
    def near(*runs):
        return leaks._report(pd.DataFrame([(0, 0, *r) for r in runs], columns=["doc", "item", "p", "q", "n"]), 10)["near"].tolist()

    assert near((0, 0, 8), (0, 50, 8), (9, 9, 8)) == [16] and near((0, 0, 8), (12, 0, 8), (20, 0, 8)) == [8]
    assert near((0, 0, 8), (8, 0, 8), (300, 290, 9)) == [17] and near((0, 0, 8)) == [8]


# --- 9 quality ----------------------------------------------------------------


def measures(t, common):
    t = t or ""
    p, ink, w = t.split(), [c for c in t if not c.isspace()], words(t)
    lines = [x for x in t.split("\n") if x.strip()]
    return (
        len(p), sum(map(len, p)) / max(1, len(p)), sum(not c.isalnum() for c in ink) / max(1, len(ink)),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)), sum(x in common for x in w) / max(1, len(w)),
    )


PROSE = "The reader keeps a note in the folder and it is there for the week. " * 12


def test_statistics(spark):
    docs = [(1, PROSE), (2, "| a | b |\n|---|---|\n" + "| 1 | 2 |\n" * 40), (3, "- [[link one]]\n" * 40), (4, "#$%&/ ()=? {}\n" * 40), (5, None), (6, ""), (7, "TODO later"), (8, PROSE.replace(". ", ".\r\n")), (9, "é" * 50000), (None, "x"), (10, "\n" * 3000 + "a.")]
    df = spark.createDataFrame([(*d, 0) for d in docs], "doc_id bigint, text string, flags int")
    common = spark.createDataFrame([("en", w) for w in ("the", "a", "in", "and", "it", "is", "for", "there", None)], "lang string, word string")
    got = {r["doc_id"]: r for r in quality.statistics(df, common).collect()}
    known = {"the", "a", "in", "and", "it", "is", "for", "there"}
    assert set(got) == {d for d, _ in docs if d is not None}
    for d, t in docs:
        if d is not None:
            r = got[d]
            assert [r["pieces"], r["mean_length"], r["symbol_ratio"], r["ended_lines"], r["common_share"]] == pytest.approx(list(measures(t, known)))
    assert got[1]["prose"] > 0.9 and got[8]["prose"] > 0.9 and got[2]["table"] > 0.9 and got[3]["list"] > 0.9 and got[4]["junk"] + got[4]["table"] > 0.9
    assert {2, 3, 4, 5, 6} <= {r[0] for r in quality.not_prose(quality.statistics(df, common)).collect()} and 1 not in {r[0] for r in quality.not_prose(quality.statistics(df, common)).collect()}
    assert quality.statistics(df.limit(0), common.limit(0)).count() == 0


def lines_of_texts():
    rng = np.random.default_rng(3)
    doc = np.sort(rng.integers(0, 9, 120))
    return rng.integers(0, quality.SYMBOLS, 120), doc


def test_decode_equals_one_by_one():
    symbol, doc = lines_of_texts()
    model = quality.start_model()
    got = quality.decode(symbol, doc, model)
    with np.errstate(divide="ignore"):
        begin, move, end, emit = (np.log(x) for x in model)
    for d in np.unique(doc):
        s = symbol[doc == d]
        score, back = begin + emit[:, s[0]], []
        for x in s[1:]:
            ways = score[:, None] + move
            back.append(ways.argmax(0))
            score = ways.max(0) + emit[:, x]
        path = [int((score + end).argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert got[doc == d].tolist() == path[::-1]
    assert len(quality.decode(symbol[:0], doc[:0], model)) == 0


def test_expected_counts_equal_the_sum_over_all_paths():
    symbol, doc = lines_of_texts()
    symbol, doc = np.concatenate([symbol[doc == d][:4] for d in range(9)]), np.concatenate([doc[doc == d][:4] for d in range(9)])
    model = begin, move, end, emit = quality.start_model()
    want = np.zeros(25 + 4 * quality.SYMBOLS)
    for d in np.unique(doc):
        s = symbol[doc == d]
        paths = list(product(range(4), repeat=len(s)))
        chance = [begin[p[0]] * np.prod([move[a, b] for a, b in zip(p, p[1:])]) * np.prod([emit[k, x] for k, x in zip(p, s)]) * end[p[-1]] for p in paths]
        for p, c in zip(paths, np.array(chance) / sum(chance)):
            want[p[0]] += c
            want[20 + p[-1]] += c
            for a, b in zip(p, p[1:]):
                want[4 + 4 * a + b] += c
            for k, x in zip(p, s):
                want[25 + k * quality.SYMBOLS + x] += c
        want[24] += np.log(sum(chance))
    got = quality.expect(symbol, doc, model)
    assert np.allclose(got, want)
    like, model = [got[24]], quality.fitted(got, model, 0.0)
    for _ in range(5):
        got = quality.expect(symbol, doc, model)
        like.append(got[24])
        model = quality.fitted(got, model, 0.0)
    assert all(a <= b + 1e-9 for a, b in zip(like, like[1:])) and (model[3][0][quality.start_model()[3][0] == 0] == 0).all()
    assert not quality.expect(symbol[:0], doc[:0], model).any()


# --- queries ------------------------------------------------------------------


def test_every_problem_has_its_queries():
    from notegrid.llm import queries

    names = set(queries.QUERIES)
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6, 7, 8, 9)} <= names and set(queries.SQL) <= names
    assert F is not None
