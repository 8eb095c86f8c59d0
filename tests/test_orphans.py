from datetime import datetime as D

from notegrid.operators import orphans, wikirefs


def frames(spark, notes, refs, heads):
    n = spark.createDataFrame(notes, "note_id bigint, title string, ctx array<string>, links array<string>, created_at timestamp, deleted_at timestamp, key string, rep string")
    r = spark.createDataFrame(refs, "ref_id bigint, title string, ctx_path array<string>, heading string, seen_at timestamp, key string")
    h = spark.createDataFrame(heads, "note_id bigint, text string, level int, key string")
    return n, r, h


def test_missing(spark):
    notes = [
        (1, "A", None, ["A", "x/B", "gone", "gone", None], D(2024, 1, 5), None, "k", "r"),
        (2, "B", ["x"], None, D(2024, 2, 1), D(2024, 3, 1), "k", "r"),
        (3, "B", ["x"], [], D(2024, 4, 1), None, "k", "r"),
        (4, None, None, ["late"], None, None, None, None),
    ]
    refs = [
        (10, "B", ["x"], None, D(2024, 2, 15), "k"), (11, "B", ["x"], None, D(2024, 3, 1), "k"), (12, "B", ["x"], None, D(2024, 5, 1), "k"),
        (13, "A", [], "Part - ONE!", D(2024, 6, 1), "k"), (14, "A", [], "other", D(2024, 6, 1), "k"), (14, "A", [], "other", D(2024, 6, 1), "k"),
        (15, "x/B", [], None, D(2024, 6, 1), "k"), (16, "A", [], None, None, "k"), (17, "A", [], None, D(2024, 1, 1), "k"),
    ]
    n, r, h = frames(spark, notes, refs, [(1, "part one", 1, "k"), (1, "part one", 1, "k"), (None, None, None, None)])
    got = {tuple(x) for x in wikirefs.missing(n, r, h).collect()}
    assert got == {
        ("links", "2024-01", 1, "gone"), ("links", None, 4, "late"), ("refs", "2024-03", 11, "x/B"), ("refs", "2024-06", 14, "A"),
        ("refs", "2024-06", 15, "x/B"), ("refs", None, 16, "A"), ("refs", "2024-01", 17, "A"),
    }
    report = {tuple(x) for x in wikirefs.report(n, r, h).collect()}
    assert ("notes", "2024-01", 1, 1) in report and ("headings", "2024-06", 1, 1) in report and ("refs", "2024-06", 1, 1) in report


def test_empty_tables(spark):
    n, r, h = frames(spark, [], [], [])
    assert wikirefs.missing(n, r, h).count() == 0 and wikirefs.report(n, r, h).count() == 0


def test_spans_merge(spark):
    rows = [("k", D(2024, 1, 1), D(2024, 1, 10)), ("k", D(2024, 1, 5), D(2024, 1, 20)), ("k", D(2024, 2, 1), None), ("k", D(2024, 3, 1), None), ("k", None, None), ("k", D(2024, 1, 20), D(2024, 1, 21))]
    got = sorted(tuple(x)[1:] for x in orphans.spans(spark.createDataFrame(rows, "key string, begin timestamp, end timestamp")).collect())
    assert got == [(D(2024, 1, 1), D(2024, 1, 21)), (D(2024, 2, 1), None)]


def test_missing_at_holds_each_child_against_the_spans_of_its_group(spark):
    from datetime import datetime

    def day(n):
        return datetime(2024, 1, n)

    parents = spark.createDataFrame([("a", day(2), day(5)), ("a", day(4), day(6)), ("a", day(9), None), ("b", None, None), ("c", day(5), day(5)), (None, day(3), None)], "key string, begin timestamp_ntz, end timestamp_ntz")
    asked = [("a", 1), ("a", 2), ("a", 5), ("a", 6), ("a", 8), ("a", 20), ("b", 3), ("c", 5), ("z", 3), (None, 2), (None, 3), ("a", None)] + [("a", 3)] * 50
    children = spark.createDataFrame([(k, day(n) if n else None, i) for i, (k, n) in enumerate(asked)], "key string, at timestamp_ntz, id int")
    got = {r["id"] for r in orphans.missing_at(children, parents, "at").collect()}
    assert got == {i for i, (k, n) in enumerate(asked[:12]) if (k, n) in {("a", 1), ("a", 6), ("a", 8), ("b", 3), ("c", 5), ("z", 3), (None, 2), ("a", None)}}
    assert orphans.missing_at(children.limit(0), parents, "at").count() == 0 and orphans.missing_at(children, parents.limit(0), "at").count() == len(asked)
