"""Columns of any name, and rows that are hard to read: nothing crashes and nothing changes that an operator does not own."""

import pytest
from pyspark.sql import functions as F

from llm_rows import PROSE

#: Names that operators use inside, have used, or return.
NAMES = (
    "u v w t d c h k n s row rows words lines spans order at own key doc mark like of drops host path page pages sig rep comp label node size gone first last bucket kind pattern"
    " hash range ranges hashes segment bits best total buckets counts docs capture named refers piece chunk salt shard slot band least q_key _k0 _k1 _n _d _c item item_id _rl_text a.b `tick"
).split()


@pytest.fixture
def named(spark):
    """Documents with a column of each name; its values are its name and row."""
    rows = [(1, PROSE + "\nA common line of text"), (2, PROSE + "\nA common line of text\nand more"), (3, None), (4, ""), (5, "völlig andere Wörter stehen hier in einem Text mit mehr als zehn Wörtern, so dass er bleibt")]
    df = spark.createDataFrame([(i, f"http://h.org/{i}", t, "2024-05-01") for i, t in rows], "doc_id long, url string, text string, fetched_at string")
    return df.withColumns({n: F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")) for n in NAMES})


def same(got, new=(), ids=None):
    rows = got.collect()
    kept = [n for n in NAMES if n not in new]
    assert set(kept) <= set(got.columns) and (ids is None or {r["doc_id"] for r in rows} == ids)
    for r in rows:
        assert all(r[n] == f"{n}/{r['doc_id']}" for n in kept), [n for n in kept if r[n] != f"{n}/{r['doc_id']}"]


def test_url_filters(named, spark):
    from runledger.llm.url_filters import filter_captures

    entries = spark.createDataFrame([("l", "block", "domain", "h.org", "add", "2024-01-01")], "list_name string, action string, kind string, pattern string, change string, at string").withColumn("at", F.col("at").cast("timestamp"))
    same(filter_captures(named, entries), ("host", "pattern"), {1, 2, 3, 4, 5})


def test_lines(named):
    from runledger.llm.line_dedup import dedup_lines

    got = dedup_lines(named)
    same(got, (), {1, 2, 3, 4, 5})
    assert {r.doc_id: r.text for r in got.collect()}[2] == "and more"


def test_quality(named):
    from runledger.llm.quality import apply_rules, keep_good, text_statistics

    odd = named.withColumns({"n_lines": F.lit(777), "kept": F.lit("mine"), "rule_no": F.lit("r"), "n_words": F.lit(-1)})
    got = keep_good(odd, [])
    same(got, (), {1, 2, 5})
    assert got.columns == odd.columns and {(r.n_lines, r.kept, r.rule_no, r.n_words) for r in got.collect()} == {(777, "mine", "r", -1)}
    same(apply_rules(named, []), (), {1, 2, 3, 4, 5})
    same(text_statistics(named), (), {1, 2, 3, 4, 5})


def test_near_duplicates(named):
    from runledger.llm.near_dup import drop_near_duplicates

    got = drop_near_duplicates(named)
    same(got, (), {1, 3, 4, 5})
    assert got.columns == named.columns


def test_leaks(named, spark):
    from runledger.llm.decontam import drop_leaks

    got = drop_leaks(named, spark.createDataFrame([(1, PROSE)], "item_id int, text string"))
    same(got, (), {3, 4, 5})
    assert got.columns == named.columns


def test_language(named):
    from runledger.llm.langid import predict, train

    model = train(named.withColumn("lang", F.lit("en")))
    got = predict(named.withColumn("lang_pred", F.lit("x")), model, keep=("doc_id", *NAMES, "lang_pred"))
    same(got, (), {1, 2, 3, 4, 5})
    assert got.columns.count("lang_pred") == 1 and {r.lang_pred for r in got.collect()} == {"en", "und"}


def test_pages(named):
    from runledger.llm.html_text import extract_pages

    got = extract_pages(named.withColumnRenamed("text", "html"))
    same(got, (), {1, 2, 3, 4, 5})


def test_shards_pieces_and_captures_have_columns_of_their_own(named):
    import public_tokenizers

    from runledger.llm.packing import pack_documents
    from runledger.llm.scratch import Scratch
    from runledger.llm.sharding import assign_shards
    from runledger.llm.warc import write_archives

    s = Scratch(named.sparkSession, "t")
    assert assign_shards(named).count() == 5 and pack_documents(named, public_tokenizers.path("byte_bpe_50k.json")).count() == 5 and write_archives(named, f"{s.dir}/a", s, "doc_id", "url", "text").count() == 5


@pytest.fixture
def long(spark):
    """A very long line, a very long text of short lines, and one word a hundred thousand times."""
    rows = [(1, "x" * 1_000_000), (2, "\n".join(f"line number {k} of a long text" for k in range(40_000))), (3, "a " * 100_000), (4, "\n".join(f"line number {k} of a long text" for k in range(40_000)))]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_very_long_texts(long, spark):
    import public_tokenizers

    from runledger.llm.decontam import find_leaks
    from runledger.llm.langid import predict, train
    from runledger.llm.line_dedup import dedup_lines
    from runledger.llm.near_dup import near_duplicates
    from runledger.llm.packing import pack_documents
    from runledger.llm.quality import apply_rules
    from runledger.llm.sharding import assign_shards

    assert {r.doc_id: r.n_dropped for r in dedup_lines(long).collect()} == {1: 0, 2: 0, 3: 0, 4: 40_000}
    assert {r.doc_id: r.component_id for r in near_duplicates(long).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}
    bench = spark.createDataFrame([(1, "a " * 300), (2, "zebra " * 30)], "item_id int, text string")
    assert [(r.doc_id, r.item_id, r.tiled_words) for r in find_leaks(long, bench).collect()] == [(3, 1, 300)]
    assert {r.doc_id: (r.n_words, r.n_repeat_words) for r in apply_rules(long, []).collect()}[3] == (100_000, 100_000)
    assert predict(long, train(long.withColumn("lang", F.lit("en")))).count() == 4 and assign_shards(long, n_shards=2).count() == 4
    pieces = pack_documents(long, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert {r.doc_id for r in pieces} == {1, 2, 3, 4} and max(r.offset + r.length for r in pieces) <= 2048
