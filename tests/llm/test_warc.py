import gzip
import hashlib
import random
from glob import glob

import pytest
from pyspark.sql import functions as F

from tessera.llm import warc as W

SCHEMA = "page_id long, url string, html string"
LONG = "x" * 100
ROWS = [
    (5, "http://www.Example.org:80/b?q=1#frag", LONG),
    (3, "https://example.org/a", LONG),
    (9, None, LONG),
    (None, "http://example.org/b?q=1", LONG),
    (4, "http://u:p@sub.example.org", "y" * 99),
    (6, "ftp://sub.example.org/ü x", "y" * 99),
    (7, "no scheme", None),
    (8, "http://a.b/\r\nWARC-Type: revisit\t", ""),
    (10, "", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 9),
    (11, "http://z.org/", "Grüße 漢字 🎉 \x00 " * 30_000),
    (12, "http://z.org/", "Grüße 漢字 🎉 \x00 " * 30_000),
    (3, "https://example.org/a", LONG),
    (None, None, "only copies without an id " * 9),
    (None, None, "only copies without an id " * 9),
    (-2, "http://[::1]:8080/p?", "z" * 200),
]


def plain(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        again = len(raw) >= 100 and first.get(html or "") not in (None, i)
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[html or ""] if again else None))
    return sorted(out, key=str)


def test_query_against_plain(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(4)
    df = df.select("*", *[F.lit(f"own {n}").alias(n) for n in ("id", "payload", "digest", "n", "first", "value", "captured", "url_key", "copies", "range", "place")])
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = W.op13_warc(spark, str(tmp_path)).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == plain(ROWS)
    order = sorted(got, key=lambda r: r["position"])
    assert [r["position"] for r in order] == list(range(len(ROWS)))
    assert [(r["url_key"], r["page_id"] is not None, r["page_id"] or 0) for r in order] == sorted((r["url_key"], r["page_id"] is not None, r["page_id"] or 0) for r in got)
    keys = {r["page_id"]: r["url_key"] for r in got}
    assert keys[5] == "org,example)/b?q=1" and keys[4] == "org,example,sub)/" and keys[9] == "" and keys[-2] == "[::1]:8080)/p?"


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op13_warc(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_are_runs_and_hold_all(spark, tmp_path, compression, monkeypatch):
    """Files are cut by size, hold sorted records that another reader of the format can walk, and give every payload back."""
    monkeypatch.setattr(W, "ARCHIVE", 20_000)
    r = random.Random(5)
    rows = [(i, f"http://h{r.randrange(9)}.org/{r.randrange(40)}", f"2024-01-{r.randrange(1, 29):02}T00:00:00Z", r.choice([f"body {i} " * 40, "shared " * 40])) for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, at string, html string").repartition(3)
    W.write_archives(df, f"{tmp_path}/w", date_col="at", compression=compression)
    files = sorted(glob(f"{tmp_path}/w/part-*"))
    assert len(files) > 3
    payloads, n = {}, 0
    for f in files:
        raw = open(f, "rb").read()
        raw = gzip.decompress(raw) if compression == "gzip" else raw
        last, at = None, 0
        while at < len(raw):  # plain cutting by Content-Length
            head, _, _ = raw[at:].partition(b"\r\n\r\n")
            h = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            end = at + len(head) + 4 + int(h["Content-Length"])
            assert raw[end : end + 4] == b"\r\n\r\n"
            key = (W.url_key, h["WARC-Target-URI"].removeprefix("http://").replace(".org", "").partition("/")[::2], h["WARC-Date"], h["WARC-Record-ID"])[1:]
            assert last is None or (key[0][0], "/" + key[0][1], *key[1:]) >= last
            last, at, n = (key[0][0], "/" + key[0][1], *key[1:]), end + 4, n + 1
    assert n == 300
    got = W.read_archives(spark, f"{tmp_path}/w", payloads=True).collect()
    for x in got:
        if x["record_type"] == "response":
            payloads[x["page_id"]] = bytes(x["payload"]).decode()
    assert {x["page_id"]: payloads[x["page_id"] if x["refers_to"] is None else x["refers_to"]] for x in got} == {i: html for i, _, _, html in rows}
    index = W.merged_index(W.read_archives(spark, f"{tmp_path}/w"), range_rows=37).orderBy("position").collect()
    want = sorted((f"org,{u[7:9]}){u[13:]}", at, i) for i, u, at, _ in rows)
    assert [(x["url_key"], x["captured"], x["page_id"]) for x in index] == want
    if compression == "none":  # an entry finds its record
        for x in index[::29]:
            raw = open(f"{tmp_path}/w/{x['archive']}", "rb").read()[x["offset"] : x["offset"] + x["length"]]
            assert W.entry(*list(W.parse(raw))[0][2:])[0]["page_id"] == x["page_id"]


def test_damage_is_seen(spark, tmp_path):
    W.write_archives(spark.createDataFrame([(1, "http://a.b/", "some text")], SCHEMA), f"{tmp_path}/w")
    raw = b"".join(open(f, "rb").read() for f in glob(f"{tmp_path}/w/part-*"))
    headers, block = list(W.parse(raw))[0][2:]
    with pytest.raises(ValueError):
        W.entry(headers, block.replace(b"some", b"same"))
    with pytest.raises(ValueError):
        list(W.parse(raw[:-3]))
    with pytest.raises(ValueError):
        list(W.parse(b"junk" + raw))


def test_loser_tree():
    r = random.Random(1)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(r.randrange(50) for _ in range(r.randrange(9))) for _ in range(k)]
        assert list(W.LoserTree(runs)) == sorted(x for run in runs for x in run)
    assert W.sorted_runs([(1,), (1,), (0,), (5,)]) == [[((1,), 0), ((1,), 1)], [((0,), 2), ((5,), 3)]]
    assert [W.id_of(f"urn:uuid:{h}") for h in ("00000000-0000-8000-8700-000000000000", "ffffffff-ffff-8fff-8e00-000000000000", "00000000-0000-8000-8000-ffffffffffff")] == [7, -2, None]
