import random

import pytest

from tessera.operators import chunking

SPACE = " \t\n\x0b\x0c\r\x85\xa0 "


def plain(text: str, target: int) -> list[str]:
    out, lines, size, start = [], text.split("\n"), 0, 0
    for i, line in enumerate(lines):
        bare = line.strip()
        score = 100 if bare.startswith("#") else 80 if bare.startswith(("```", "~~~")) else 20 if not bare else 0
        size += len(line) + 1
        if size < target // 4:
            continue
        if size >= target or (score and score * max(0.0, 1 - abs(size - target) / target) >= 20):
            out.append("\n".join(lines[start : i + 1]).rstrip())
            start, size = i + 1, 0
    if start < len(lines):
        out.append("\n".join(lines[start:]).rstrip())
    return [c for c in out if c]


def rows(spark, texts, target):
    docs = [(i, [(f"h{k}", t, k) for k, t in enumerate(ts)]) for i, ts in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, sections array<struct<heading_path:string,text:string,ordinal:int>>")
    out = {i: [] for i in range(len(texts))}
    for r in chunking.chunk_sections(df, target).orderBy("doc_id", "seq").collect():
        out[r["doc_id"]].append(r)
    return out


@pytest.mark.parametrize("target", [256, 64, 50])
def test_equals_plain_python(spark, target):
    rng = random.Random(target)
    line = lambda: rng.choice(["", "  ", "# head", "```", "~~~", "short", "word " * rng.randint(1, 40), "漢字" * rng.randint(1, 30), "é" * 20])
    texts = [["\n".join(line() for _ in range(rng.randint(1, 40)))] for _ in range(150)]
    for i, found in rows(spark, texts, target).items():
        assert [r["text"] for r in found] == plain(texts[i][0], target)


def test_seq_runs_through_sections(spark):
    texts = [["a\n" * 40, "", "b\n" * 40], [], ["x"]]
    found = rows(spark, texts, 32)
    assert [r["seq"] for r in found[0]] == list(range(len(found[0])))
    assert {r["heading_path"] for r in found[0]} == {"h0", "h2"} and {r["ordinal"] for r in found[0]} == {0, 2}
    assert found[1] == [] and len(found[2]) == 1


def test_small_and_large(spark):
    found = rows(spark, [["small text"], ["\n".join("a line of some length here" for _ in range(50))], ["é"]], 64)
    assert len(found[0]) == 1 and len(found[1]) >= 2
    assert found[2][0]["content_length"] == 2


def test_a_breaking_heading_ends_its_chunk(spark):
    found = rows(spark, [["x" * 30 + "\n# next\nrest"]], 50)
    assert [r["text"] for r in found[0]] == ["x" * 30 + "\n# next", "rest"]
