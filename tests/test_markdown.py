import time

import pytest

from notegrid.functions.html import Renderer, slug
from notegrid.functions.markdown import heading_slug, scan, section


def kinds(text):
    return [(r[0], "/".join([*r[1], r[2]]), r[3], r[4]) for r in scan(text).refs]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("see [[n]] #[[t/u]] ![[e#h]]", [("link", "n", None, None), ("tag", "t/u", None, None), ("embed", "e", "h", None)]),
        ("[[x/y/z#part|name]]", [("link", "x/y/z", "part", "name")]),
        ("`[[q]]`", []), ("```\n[[q]]\n```", []), ("~~~\n[[q]]\n~~~", []), ("    [[q]]", []), ("a\n    [[q]]", [("link", "q", None, None)]),
        ("[[]]", []), ("[[open", []), ("[[a|b|c]]", []), ("##[[t]]", [("tag", "t", None, None)]), ("#[[t/]] #[[/t]]", []),
        ("! [[n]]", [("link", "n", None, None)]), ("!\n[[n]]", [("link", "n", None, None)]), ("![[n|alias]]", []),
        ("[[n]] [[n]]", [("link", "n", None, None)] * 2), ("> [[q]]\n\n- a\n  - [[r]]", [("link", "q", None, None), ("link", "r", None, None)]),
        ("- x\n  ```\n  [[no]]\n  ```\n- [[yes]]", [("link", "yes", None, None)]), ("[[設計/メモ]]", [("link", "設計/メモ", None, None)]),
    ],
)
def test_refs(text, expected):
    assert kinds(text) == expected


def test_lines_are_the_same_with_crlf():
    text = "# A\n\n#[[t]]\n\nB\n===\n\n```py title=x\nx\n```\n- [x] done\n"
    a, b = scan(text), scan(text.replace("\n", "\r\n"))
    assert (a.refs, a.headings, a.code, a.tasks) == (b.refs, b.headings, b.code, b.tasks)
    assert a.refs[0][5] == 3 and a.headings[1][:3] == (1, "B", 5) and a.code == [("py", "x\n", 8)] and a.tasks == [("done", "done", 11)]


def test_heading_parents():
    h = scan("A\n=\n\n#### D\n\n## B\n\n> # Q\n\n### C").headings
    assert [(x[0], x[1], x[3], x[4]) for x in h] == [(1, "A", None, True), (4, "D", "A", True), (2, "B", "A", True), (1, "Q", None, False), (3, "C", "Q", True)]


def test_section_takes_the_first_of_equal_headings_and_no_quoted_one():
    text = "# T\n\n## Same\nfirst\n### deeper\nx\n## Same\nsecond\n> ## Quoted\n"
    assert section(text, "same") == "first\n### deeper\nx\n"
    assert section(text, "quoted") is None and section(None, "x") is None
    assert heading_slug("Hello, World! -- Ünï") == "hello-world-ünï"


def test_tasks():
    got = scan("- [ ] a `c` b\n- [X] **bold** [[l/k]]\n- [-] d\n- [/] no\n- [?] no\n  - [x] nested\n\n> - [ ] quoted\n\n```\n- [ ] code\n```\n").tasks
    assert [(s, t) for s, t, _ in got] == [("open", "a  b"), ("done", "bold l/k"), ("deferred", "d"), ("done", "nested"), ("open", "quoted")]


def test_images():
    assert scan("![a](nope) ![b](https://e.example/b.png) `![c](https://e.example/c.png)`").images == ["https://e.example/b.png"]
    assert scan(None).images == [] and scan("").refs == []


def test_html():
    texts = {("b",): "## Part\n\ninner ![[a]]\n", ("a",): "x ![[b]]"}
    r = Renderer("https://e/", lambda c, t: texts.get((*c, t)))
    assert r.render("[[x/Y Z#H|n]]") == '<p><a href="https://e/notes/x/y-z.html#h">n</a></p>'
    assert r.render("#[[t/u]]") == '<p><a class="tag" href="https://e/tags/t/u.html">#t/u</a></p>'
    out = r.render("![[a]]")
    assert "embed-cycle" in out and "inner" in out
    assert "embed-missing" in r.render("![[gone]]")
    assert r.content("<https://e.example/>\n\ntext")[0] == ("autolink", "https://e.example/")
    assert r.render("```mermaid\na<b\n```") == '<div class="mermaid">a&lt;b\n</div>'
    assert r.render("1. a\n2. b") == "<ol><li>a</li><li>b</li></ol>" and "checked" in r.render("- [x] d")
    assert Renderer("https://e").render("![[a]]") == "<p>![[a]]</p>"
    assert slug(" A: b/c ") == "a-colon-b-slash-c"


def test_section_keeps_every_character_of_its_lines():
    assert section("# O\n\n## Lines\n", "lines") == "" and section("# O\n\n## Lines", "lines") == "" and section("# A\nx\n\n", "a") == "x\n\n"
    assert section("# A\r\nx\x0cy z\r\n\n# B\rw", "a") == "x\x0cy z\r\n\n" and section("# A\r\nx\n# B\rw", "b") == "w"
    assert section("Two\nlines\n=====\nbody\n# C\n", "two-lines") is None and section("Two\nlines\n=====\nbody\n# C\n", "twolines") == "body\n"


def test_references_of_any_length():
    name, alias = "n" * 70_000, r"a\]" * 2000
    assert kinds(f"[[{name}]] #[[t/{name}]] ![[{name}#h]]") == [("link", name, None, None), ("tag", f"t/{name}", None, None), ("embed", name, "h", None)]
    assert kinds(f"[[n|{alias}]]") == [("link", "n", None, "a]" * 2000)]
    assert kinds("[[" + "a" * 500_000) == [] and kinds("[[a" * 100 + r"\]" * 50_000) == []


ODD = {
    "quotes": ">" * 100_000, "quotes and a line that carries on": ">" * 100_000 + "\nlazy", "open brackets": "[" * 100_000, "images": "![a" * 33_000, "backticks": "`" * 100_000,
    "backticks in pairs": "` `` " * 20_000, "backticks of all lengths": "".join("`" * i + " " for i in range(440)), "stars": "*" * 100_000, "open stars": "*a " * 33_000, "underscores": "_a " * 33_000,
    "items": "- " * 50_000 + "x", "items of both kinds": "1. - " * 20_000 + "[ ] x", "open tags": "<!" * 50_000, "open comments": "<!-- > " * 14_000, "link target of blanks": "[a](" + " " * 100_000,
    "open link titles": '[a](b "' * 12_000, "nested links": "[" * 20_000 + "](u)" * 20_000, "open wiki links": "[[a" * 33_000, "heading of blanks": "# a" + " " * 100_000 + "b", "definitions": "[a]: " * 20_000,
    "backslashes": "\\" * 100_000, "dollars": "$a " * 30_000, "carets": "^a" * 30_000, "tildes": "~~a " * 30_000, "URLs": "http://a " * 10_000, "table": "a|b\n-|-\n" * 5_000, "bars": "|" * 50_000 + "\n" + "-|" * 50_000,
}


@pytest.mark.parametrize("text", ODD.values(), ids=ODD)
def test_odd_texts_take_little_time(text):
    begin = time.perf_counter()
    scan(text)
    assert time.perf_counter() - begin < 1.5  # a tenth of it alone
    Renderer("https://e").render(text)
    assert time.perf_counter() - begin < 5


def test_deep_containers_are_read():
    assert scan("> " * 3000 + "[[x]] #[[t]]").refs[0][2] == "x" and scan("- " * 3000 + "[x] done [[y]]").tasks == [("done", "done y", 1)]
    assert Renderer("https://e").render("> " * 3 + "a") == "<blockquote><blockquote><blockquote><p>a</p></blockquote></blockquote></blockquote>"
    assert Renderer("https://e").render("- - a\n- b") == "<ul><li><ul><li>a</li></ul></li><li>b</li></ul>"
    assert scan(">> a\nlazy [[z]]\n\n> # h\n").headings == [(1, "h", 4, None, False)]


def test_only_what_is_wanted_is_scanned():
    text = "# H *x*\n\n[[a]] #[[t]] ![i](https://e.x/i.png)\n\n- [ ] do [[b]]\n\n```py\nc\n```\n"
    whole = scan(text)
    for part in ("refs", "headings", "code", "tasks", "images"):
        one = scan(text, frozenset((part,)))
        assert getattr(one, part) == getattr(whole, part) != []
        assert all(not getattr(one, x) for x in ("refs", "headings", "code", "tasks", "images") if x != part)


@pytest.mark.parametrize(
    "text, html",
    [
        ("| a | b |\n|:-:|--:|\n| 1 \\| 2 | `x` |\n| 3 |", '<table><thead><tr><th align="center">a</th><th align="right">b</th></tr></thead><tbody><tr><td align="center">1 | 2</td><td align="right"><code>x</code></td></tr><tr><td align="center">3</td><td align="right"></td></tr></tbody></table>'),
        ("a\n\nx | y\nno table", "<p>a</p>\n<p>x | y\nno table</p>"), ("~~gone~~ x^2^ *e*", "<p><del>gone</del> x<sup>2</sup> <em>e</em></p>"), ("$a<b$ $$c$$ 5$ and 6$", '<p><span data-math-style="inline">a&lt;b</span> <span data-math-style="display">c</span> 5$ and 6$</p>'),
        ("see https://e.x/a_b. (http://e.y/(z))", '<p>see <a href="https://e.x/a_b">https://e.x/a_b</a>. (<a href="http://e.y/(z)">http://e.y/(z)</a>)</p>'), ("a &amp; b &copy;", "<p>a &amp; b ©</p>"),
        ("x[^n][^n] y[^m]\n\n[^n]: note *t*", '<p>x<sup class="footnote-ref"><a href="#fn-n" id="fnref-n">1</a></sup><sup class="footnote-ref"><a href="#fn-n">1</a></sup> y[^m]</p>\n<section class="footnotes"><ol><li id="fn-n">note <em>t</em> <a href="#fnref-n">↩</a></li></ol></section>'),
        ("<https://e.x/y>", '<p><div class="link-card" data-url="https://e.x/y" data-host="e.x"><a href="https://e.x/y" rel="noopener noreferrer">https://e.x/y</a></div></p>'),
        ("***", "<hr>"), ("![a *b*](u.png) [l **m**](v)", '<p><img src="u.png" alt="a *b*"> <a href="v">l <strong>m</strong></a></p>'),
    ],
)
def test_html(text, html):
    assert Renderer("https://e").render(text) == html


def test_embed_chains_of_any_length_and_cycles():
    chain = {f"n{i}": f"![[n{i + 1}]]" for i in range(3000)} | {"a": "x ![[b]]", "b": "![[a]] ![[c#Two Words]]", "c": "# One\n\n1\n\n## Two words\n\n2\n"}
    r = Renderer("https://e", lambda c, t: chain.get(t))
    assert r.render("![[n0]]").count('<div class="embed">') == 3000
    assert r.render("![[a]]") == '<p><div class="embed"><p>x <div class="embed"><p><div class="embed-cycle">a</div> <div class="embed"><p>2</p></div></p></div></p></div></p>'
