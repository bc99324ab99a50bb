import os
import random

import pytest

from tessera.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="no tokenizer files")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def check(df, library, **how):
    rows = pieces.decode(pieces.encode(df, decoded_col="same", **how)).collect()
    assert len(rows) == df.count() and all(r["same"] == r["decoded"] for r in rows)
    for r in rows:
        assert r["ids"] == library.encode(r["text"] or ""), r["text"]
        if "▁" not in (r["text"] or ""):
            assert r["decoded"] == (r["text"] or "")


def texts(spark):
    rng = random.Random(5)
    words = ["the", "running", "é", "漢字", "🎉", "ﬁ", "==", "----", "aaaaaaa", "  ", "\n", "\t", "\0", "▁", "Straße", "https://x.y/z?a=1", "x" * 60, "q" * 200]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " ", "  ", "\n"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(200 + i, "".join(rng.choice("etaoinshrd ") for _ in range(200))) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


@pytest.mark.parametrize("known", [pieces.KNOWN, 20, 0])
def test_equals_the_library(spark, library, known):
    check(texts(spark), library, known=known)


def test_edge_cases(edge, none, clash, library):
    check(edge, library)
    check(edge, library, known=0)
    assert pieces.encode(none).collect() == []
    out = pieces.encode(clash)
    assert [c for c in out.columns if c != "ids"] == [c for c in clash.columns if c != "ids"]
    assert {r["unit"] for r in out.collect()} == {"own unit"}


def test_decode_of_odd_ids(spark):
    rows = [(1, [65, 10**6, -1]), (2, None), (3, []), (4, [3 + 0xFF])]
    got = {r["k"]: r["decoded"] for r in pieces.decode(spark.createDataFrame(rows, "k long, ids array<int>")).collect()}
    assert got[2] is None and got[3] == "" and got[4] == "�" and got[1] == "A"[:0] + pieces.text_from([65], dict(enumerate(pieces.load().text_of)))


def test_long_runs_and_odd_spaces(spark, library):
    texts = [*(" " * n for n in range(1, 80)), *("a" + " " * n + "b" for n in range(10, 40)), "=" * 3000, " " * 500 + "x", "x" + " " * 70, "  lead", "trail  ", " ", "  ", "a  b   c\n d", "\n", " \n ", "ab" * 400, "1234567890" * 30, "_-" * 100, "é" * 130]
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), library, known=5)


def test_model_order():
    model = pieces.load()
    assert all(max(pieces.merges(p, model.rank))[0] == r for p, r in list(model.rank.items())[::50] if len(p) > 1)
