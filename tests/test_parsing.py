import os

import pytest

from tessera.operators import markdown, parsing
from tessera.sources import listing


def paths(text):
    return [(s.heading_path, s.text) for s in markdown.parse(text)[1]]


def test_heading_paths_and_title():
    title, sections = markdown.parse("intro\n# A\none\n## B\ntwo\n# C\nthree\n")
    assert title == "A"
    assert [(s.heading_path, s.text) for s in sections] == [("", "intro"), ("A", "one"), ("A > B", "two"), ("C", "three")]
    assert [s.ordinal for s in sections] == [0, 8, 17, 25]


def test_skipped_levels_nest():
    assert [p for p, _ in paths("# H1\n### H3\nx\n### H3b\ny\n")] == ["H1 > H3", "H1 > H3 > H3b"]


def test_headings_only_and_underlined():
    assert paths("# A\n## B\n") == []
    title, sections = markdown.parse("Top\n===\ntext\n\nSub\n---\nmore\n")
    assert title == "Top" and [s.heading_path for s in sections] == ["Top", "Top > Sub"]


def test_code_lists_quotes():
    assert paths("# A\n\n```py\n# not a heading\n\nx\n```\n") == [("A", "# not a heading\n\nx")]
    assert paths("- one\n- two\n  and more\n\n> said\n\n---\n\n<div>\nno\n</div>\n\nlast\n") == [("", "- one\n- two and more\nsaid\nlast")]
    assert paths("    code\n\n    more\n") == [("", "code\n\nmore")]


def test_parsed_by_extension(spark):
    rows = [("a/x.md", b"# T\nbody\n"), ("b.TXT", b"plain \xff"), ("c.py", b"print()"), ("d.md", b"no heading"), ("e.txt", b" \n")]
    found = {r["path"]: r for r in parsing.parsed(spark.createDataFrame(rows, "path string, body binary")).collect()}
    assert found["a/x.md"]["title"] == "T" and found["a/x.md"]["sections"][0]["heading_path"] == "T"
    assert found["b.TXT"]["title"] == "b" and found["b.TXT"]["sections"][0]["text"] == "plain �"
    assert found["c.py"]["title"] == "c" and found["d.md"]["title"] == "d.md"
    assert found["e.txt"]["sections"] == []


@pytest.fixture
def tree(tmp_path):
    for name in ("a.md", "_index.md", ".dot.md", ".hid/d.md", "_p/e.md", "sub/F.MD", "node_modules/x.md", "skip/y.md", "z.bin"):
        p = tmp_path / "build" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("text")
    return str(tmp_path / "build")


def test_listing_keeps_hidden_names(tree):
    assert list(listing.walk(tree, ignore=("skip",))) == [".dot.md", ".hid/d.md", "_index.md", "_p/e.md", "a.md", "sub/F.MD"]
    assert list(listing.walk(tree, extensions=(".bin",))) == ["z.bin"]
    with pytest.raises(OSError):
        list(listing.walk(os.path.join(tree, "missing")))


def test_unreadable_files_have_an_error(spark, tree):
    rows = {r["path"]: r for r in listing.read_files(spark, tree, ["a.md", "gone.md"]).collect()}
    assert bytes(rows["a.md"]["body"]) == b"text" and rows["gone.md"]["error"] and rows["gone.md"]["hash"] is None


# Block examples after the public CommonMark text, as far as sections see them: text, and (heading path, text) of its sections.
CONTAINERS = [
    ("> quote\n> # inner\n> more\n", [("", "quote"), ("inner", "more")]),
    ("> # Foo\n> bar\n> baz\n", [("Foo", "bar\nbaz")]),
    (">bar\nbaz\n> foo\n", [("", "bar\nbaz\nfoo")]),
    ("> bar\n\nbaz\n", [("", "bar\nbaz")]),
    ("> > > # deep\n> > > foo\nbar\n", [("deep", "foo\nbar")]),
    ("> ```\n> # code\n> ```\nafter\n", [("", "# code\nafter")]),
    ("> ```\n# out\n", [("out", "")]),
    ("- # Foo\n- Bar\n  ---\n  baz\n", [("Foo > Bar", "baz")]),
    ("- a\n  # in item\n  text\n- b\n", [("", "- a"), ("in item", "text\n- b")]),
    ("- a\n\n  second\n\n- b\n", [("", "- a\nsecond\n- b")]),
    ("1.  one\n\n    # h\n\n    two\n\n2. three\n", [("", "- one"), ("h", "two\n- three")]),
    ("- foo\n  - bar\n    - baz\n", [("", "- foo\n- bar\n- baz")]),
    ("- foo\n\n      bar\n", [("", "- foo\nbar")]),
    ("- > quoted\n  > # h\n  > in both\nlazy\n", [("", "quoted"), ("h", "in both\nlazy")]),
    ("> - item\n> # h\ntext\n", [("", "- item"), ("h", "text")]),
    ("Foo\n---\n> a\n---\n", [("Foo", "a")]),
    ("> foo\n---\n", [("", "foo")]),
    ("- foo\n***\n- bar\n", [("", "- foo\n- bar")]),
    ("* a *\n- - x\n", [("", "- a *\n- x")]),
    ("The number is\n14. pens\n", [("", "The number is\n14. pens")]),
    ("Now\n1. pens\n", [("", "Now\n- pens")]),
    ("``` x`y\n# h\n", [("", "``` x`y")]),
    ("  - a\n    b\n c\n", [("", "- a b c")]),
]


@pytest.mark.parametrize("text, want", CONTAINERS)
def test_containers(text, want):
    assert paths(text) == [w for w in want if w[1]]


def test_ordinals_in_containers():
    text = "é\n> # One\n> a\n\n- ## Two\n  b\n"
    assert [(s.heading_path, s.ordinal) for s in markdown.parse(text)[1]] == [("", 0), ("One", text.encode().index(b"One")), ("One > Two", text.encode().index(b"Two"))]
