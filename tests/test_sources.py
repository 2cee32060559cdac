import json

import pytest
from pyspark.sql import functions as F

from gleaner.functions.text import redirect_hash
from gleaner.operators import stats as S
from gleaner.sources import articles as A
from gleaner.sources import msgpack as M
from gleaner.sources import tables as B
from gleaner.streaming import incremental as N


def test_articles_from_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<article>one two</article>")
    (tmp_path / "b.html").write_text("<p>nothing</p>")
    (tmp_path / "c.txt").write_text("not a page")
    pages = A.read_articles(spark, str(tmp_path))
    assert pages.count() == 2
    assert [r.text for r in A.parse_articles(pages).collect()] == ["one two"]


def test_article_map(spark, tmp_path):
    file = tmp_path / "map.json"
    file.write_text(json.dumps({"B": {"path": "./data/b.html"}, "A": {"path": "./data/a.html"}, "C": {"path": "./data/a_to_c.html"}, "D": {"path": None}}))
    rows = A.read_article_map(spark, str(file))
    assert [tuple(r) for r in rows.collect()] == [("A", "a.html"), ("B", "b.html")]
    listed = spark.createDataFrame([("b.html",), ("b.html",)], "path string")
    assert [r.title for r in A.existing(rows, listed).collect()] == ["B"]


def test_attach_text(spark):
    hits = spark.createDataFrame([(1, "x"), (1, "y"), (1, "z")], "qid int, doc string")
    texts = spark.createDataFrame([("x", "text"), ("z", None)], "doc string, text string")
    got = {r.doc: r.text for r in A.attach_text(hits, texts).collect()}
    assert got == {"x": "text", "y": A.MISSING + "y", "z": A.INVALID + "z"}


def test_redirects(spark):
    pages = spark.createDataFrame([("<redirect/><sha1>a</sha1>",), ("<sha1>b</sha1>",), ("<redirect/>",)], "page string")
    assert [r.sha1 for r in A.isolate_redirects(pages, redirect_hash(F.col("page"))).collect()] == ["a"]


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_formats(spark, tmp_path, fmt):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "word string, df long")
    path = str(tmp_path / fmt)
    B.save(df, path, fmt)
    B.save(df, path, fmt)  # overwrites
    assert sorted(tuple(r) for r in B.load(spark, path, fmt, "word string, df long").collect()) == [("a", 1), ("b", 2)]
    assert B.clear(spark, path) and not B.clear(spark, path)


def test_unknown_format(spark, tmp_path):
    with pytest.raises(ValueError):
        B.load(spark, str(tmp_path), "msgpack")


def test_map_file_and_postings(spark, tmp_path):
    (tmp_path / "df.json").write_text(json.dumps({"a": 3, "b": 1}))
    assert sorted(tuple(r) for r in B.load_map(spark, str(tmp_path / "df.json")).collect()) == [("a", 3), ("b", 1)]
    B.save_postings(spark.createDataFrame([("b", [1]), ("a", [1, 2])], "word string, docs array<long>"), str(tmp_path / "p"))
    plan = B.load(spark, str(tmp_path / "p")).filter("word = 'a'")._jdf.queryExecution().toString()
    assert "EqualTo(word,a)" in plan


@pytest.mark.parametrize("value, raw", [
    (None, b"\xc0"), (True, b"\xc3"), (5, b"\x05"), (-3, b"\xfd"), (200, b"\xcc\xc8"), (70_000, b"\xce\x00\x01\x11p"), (-300, b"\xd1\xfe\xd4"), (1.5, b"\xcb?\xf8" + b"\x00" * 6),
    ("ab", b"\xa2ab"), ("x" * 40, b"\xd9(" + b"x" * 40), ([1, "b"], b"\x92\x01\xa1b"), ({"a": 1}, b"\x81\xa1a\x01"), (b"z", b"\xc4\x01z"),
])
def test_msgpack_values(value, raw):
    """Bytes by the public format."""
    assert M.encode(value) == raw and M.Decoder(raw).value() == value


def test_msgpack_long_values():
    for value in ("y" * 70_000, list(range(70_000)), {str(i): i for i in range(70_000)}, 2**63, -(2**63), "é" * 300, [[]] * 20):
        assert M.Decoder(M.encode(value)).value() == value
    assert M.Decoder(b"\xca?\xc0\x00\x00").value() == 1.5
    with pytest.raises(ValueError):
        M.Decoder(b"\xc1").value()
    with pytest.raises(ValueError):
        M.Decoder(b"\xa5ab").value()


def test_msgpack_files(spark, tmp_path):
    (tmp_path / "one.msgpack").write_bytes(M.encode({"a": 3, "b": 1, 7: 2}))
    assert sorted(map(tuple, M.load_msgpack(spark, str(tmp_path / "one.msgpack")).collect())) == [("7", 2), ("a", 3), ("b", 1)]
    (tmp_path / "posts.msgpack").write_bytes(M.encode({"w": [1, 2], "v": []}))
    assert {r.key: r.value for r in M.load_msgpack(spark, str(tmp_path / "posts.msgpack"), "array<bigint>").collect()} == {"w": [1, 2], "v": []}
    (tmp_path / "articles.msgpack").write_bytes(M.encode({"A": {"path": "x"}}))
    assert M.load_msgpack(spark, str(tmp_path / "articles.msgpack"), "struct<path: string>").first().value.path == "x"


def test_msgpack_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i}", [i, None, i * 10**12]) for i in range(50)] + [("none", None), ("é", [])], "word string, docs array<long>").repartition(3)
    path = str(tmp_path / "m")
    M.save_msgpack(df, path)
    M.save_msgpack(df, path)  # overwrites
    assert sorted(map(str, M.load_msgpack(spark, path, "array<bigint>").collect())) == sorted(map(str, df.selectExpr("word AS key", "docs AS value").collect()))
    assert len(list((tmp_path / "m").glob("*.msgpack"))) == 3
    M.save_msgpack(df.limit(0), path)


def test_maps_in_both_formats(spark, tmp_path):
    df = spark.createDataFrame([(f'k"{i}', [i, 2]) for i in range(20)] + [("none", None)], "word string, docs array<long>").repartition(3)
    B.save_map(df, str(tmp_path / "both"))
    expected = sorted(map(str, df.selectExpr("word AS key", "docs AS value").collect()))
    for fmt in ("json", "msgpack"):
        assert sorted(map(str, B.load_map(spark, str(tmp_path / "both" / fmt), "array<bigint>", fmt).collect())) == expected
    with pytest.raises(ValueError):
        B.save_map(df, str(tmp_path / "x"), ("yaml",))


def test_vector_table(spark, tmp_path):
    table = B.VectorTable(spark, str(tmp_path / "v"), 2)
    row = spark.createDataFrame([("f", [0, 3], [1.0, 2.0])], "file string, start_end array<int>, vector array<float>")
    table.create(row)
    table.append(row.union(row))
    assert table.read().count() == 1
    table.append(row.withColumn("file", F.lit("g")))
    assert table.read().count() == 2
    table.create(row)
    assert table.read().count() == 1
    with pytest.raises(Exception, match="2 components"):
        table.append(row.withColumn("vector", F.array(F.lit(1.0))).withColumn("file", F.lit("h")))


def test_print_results(spark, capsys):
    B.print_results(spark.createDataFrame([(1, "d", 0.5, 1)], "qid int, doc string, score double, rank int"), "bm25")
    assert "0.5" in capsys.readouterr().out
    with pytest.raises(ValueError):
        B.print_results(spark.range(1), "other")


def test_stream_matches_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"cat dog{i % 3} cat") for i in range(10)], "doc_id long, text string")
    docs.limit(4).write.parquet(str(tmp_path / "in/1"))
    docs.exceptAll(docs.limit(4)).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    N.maintain_statistics(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    df, totals = N.current_statistics(spark, str(tmp_path / "out"))
    batch = S.analyzed(docs)
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, S.document_frequencies(S.term_frequencies(batch)).collect()))
    assert tuple(totals.first()) == tuple(S.corpus_stats(S.document_lengths(batch)).first())


def test_windowed_terms(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "cat dog"), ("2024-01-01 00:02:00", "cat"), ("2024-01-01 00:11:00", "cat")], "ts string, text string").select(F.col("ts").cast("timestamp").alias("ts"), "text")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = N.windowed_terms(stream, "ts", "text").writeStream.format("memory").queryName("terms").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.word, r.n) for r in spark.table("terms").collect()) == [("cat", 1), ("cat", 2), ("dog", 1)]
