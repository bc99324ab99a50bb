import pytest

from tessera import config as K

TEXT = """\
# top comment
database_path: data
collections:
  # the first
  - name: one
    path: docs   # where
    extensions: [.md]
  - name: two
    path: /abs
providers:
  embedding:
    name: openai
    model: m
"""


@pytest.fixture
def path(tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text(TEXT)
    return p


def test_load(path, monkeypatch):
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    c = K.load(path)
    assert c.database_path == str(path.parent / "data") and c.collections[0].path == str(path.parent / "docs")
    assert c.collections[0].extensions == (".md",) and c.search.bm25_top_k == 50 and c.search.rrf_k == 60
    assert c.embedding.base_url == K.OPENAI_URL and c.embedding.api_key == "k" and c.generation is None


@pytest.mark.parametrize("bad", ["collections:\n  - name: a\n", "collections:\n  - path: /a\n", "collections:\n  - {name: a, path: /a}\n  - {name: a, path: /b}\n", "a: [\n"])
def test_invalid(tmp_path, bad):
    (tmp_path / "c.yaml").write_text(bad)
    with pytest.raises(K.ConfigError):
        K.load(tmp_path / "c.yaml")


def test_changes_keep_comments(path):
    K.rename_collection(path, "one", "uno")
    K.add_collection(path, K.Collection("two", "/moved"))
    K.add_collection(path, K.Collection("three", "/t", "said: so", (".txt",), ("x",)))
    text = path.read_text()
    assert "# top comment" in text and "# the first" in text and "# where" in text
    c = K.load(path)
    assert [(x.name, x.path) for x in c.collections[1:]] == [("two", "/moved"), ("three", "/t")]
    assert c.collections[0].name == "uno" and c.collections[2].description == "said: so" and c.collections[2].ignore == ("x",)
    for name in ("uno", "two", "three"):
        K.remove_collection(path, name)
    assert K.load(path).collections == [] and K.load(path).embedding.model == "m"
    K.add_collection(path, K.Collection("again", "/a"))
    assert [x.name for x in K.load(path).collections] == ["again"]
    with pytest.raises(K.ConfigError):
        K.remove_collection(path, "none")
    with pytest.raises(K.ConfigError):
        K.rename_collection(path, "none", "x")


def test_template(tmp_path):
    assert K.write_template(tmp_path / "x/c.yaml") and not K.write_template(tmp_path / "x/c.yaml")
    assert K.load(tmp_path / "x/c.yaml").collections[0].name == "notes"
