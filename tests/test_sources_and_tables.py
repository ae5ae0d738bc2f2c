from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tonegauge.operators import maintenance as M
from tonegauge.plans.runs import refresh, run_current, run_legacy
from tonegauge.sources import feeds as G
from tonegauge.sources import headlines as L
from tonegauge.schemas import columns
from tonegauge.sources.keyed import KeyedTable
from tonegauge.sources.tables import TableStore
from tonegauge.operators.scoring import score_columns

ITEM = "<item><title>{}</title><pubDate>{}</pubDate><link>{}</link></item>"


def feed(*items):
    return "<rss><channel><title>t</title>" + "".join(ITEM.format(*i) for i in items) + "</channel></rss>"


def test_rss_payloads(spark):
    good = feed((" A &amp; B ", "d1", "l1"), (" ", "d2", "l2"), ("C", "d3", "l3"))
    df = spark.createDataFrame([("x", good), ("y", "<rss><channel><item>"), ("z", None)], "entity string, payload string")
    assert rows(G.parse_rss_payloads(df)) == [
        ("x", 0, "A & B", "d1", "l1"),
        ("x", 2, "C", "d3", "l3"),
    ]


def test_single_item_and_missing_fields(spark):
    df = spark.createDataFrame([("x", "<rss><channel><item><title>Only</title></item></channel></rss>")], "entity string, payload string")
    assert rows(G.parse_rss_payloads(df)) == [("x", 0, "Only", "", "")]


def test_rss_items_of_several_channels_and_beside_them(spark):
    item = lambda t: f"<item><title>{t}</title></item>"
    payloads = [
        ("two", f"<rss><channel>{item('a')}</channel><channel><title>t</title></channel><channel>{item('b')}{item('c')}</channel></rss>"),
        ("beside", f"<rdf><channel><title>t</title></channel>{item('d')}{item('e')}</rdf>"),
        ("root", f"<feed>{item('f')}</feed>"),
        ("both", f"<rss><channel>{item('g')}</channel>{item('h')}</rss>"),
        ("none", "<rss></rss>"),
    ]
    df = spark.createDataFrame(payloads, "entity string, payload string")
    got = G.parse_rss_payloads(df)
    assert rows(got, "entity", "position", "title") == [
        ("beside", 0, "d"), ("beside", 1, "e"), ("both", 0, "g"), ("both", 1, "h"), ("root", 0, "f"),
        ("two", 0, "a"), ("two", 1, "b"), ("two", 2, "c"),
    ]


def test_rss_files(spark, tmp_path):
    Path(tmp_path, "a.xml").write_text(feed(("One", "d", "l"), ("", "d", "l")))
    Path(tmp_path, "b.xml").write_text(feed(("Two", "d", "l")))
    assert rows(G.read_rss_files(spark, str(tmp_path)), "title") == [("One",), ("Two",)]


def test_news_json(spark):
    ok = """{"status": "ok", "articles": [
      {"title": "Profit at Acme rises sharply", "description": null, "publishedAt": "2024-01-05T10:00:00Z", "source": {"name": "Wire"}},
      {"title": "[Removed]", "description": "", "publishedAt": "", "source": null},
      {"title": null, "description": "Only a description here", "publishedAt": "bad", "source": {"name": null}}]}"""
    bad = '{"status": "error", "message": "no key", "articles": [{"title": "Should never be shown"}]}'
    df = spark.createDataFrame([("e", ok), ("e", bad), ("e", "{broken")], "entity string, payload string")
    assert rows(G.parse_news_json(df, as_of="2024-01-31")) == [
        ("e", date(2024, 1, 31), ". Only a description here", "", "Unknown"),
        ("e", date(2024, 1, 5), "Profit at Acme rises sharply.", "", "Wire"),
    ]


def test_ingest_feed(spark):
    day = "Wed, 10 Jan 2024 {:02d}:00:00 GMT"
    items = [(i, "acme", f"Headline number {i:02d} about Acme", day.format(i % 24), "u") for i in range(30)]
    items += [
        (30, "acme", "Headline number 00 about Acme", day.format(1), "copy"),
        (31, "acme", "short", day.format(1), "u"),
        (32, "acme", "A headline that is far too old", "Mon, 01 Jan 2024 00:00:00 GMT", "u"),
        (33, "acme", "A headline without any date", "soon", "u"),
        (34, "acme", "A headline from the future", "Fri, 12 Jan 2024 00:00:00 GMT", "u"),
        (35, "other", "Headline number 00 about Acme", day.format(1), "u"),
    ]
    df = spark.createDataFrame(items, "position int, entity string, title string, pubDate string, link string")
    out = G.ingest_feed(df, [F.col("position")], "2024-01-11 12:00:00")
    acme = out.filter("entity = 'acme'")
    assert acme.count() == 20 and acme.filter("url = 'copy'").count() == 0
    assert rows(acme, "headline")[-1] == ("Headline number 19 about Acme",)
    later = G.ingest_feed(df, [F.col("position")], "2024-01-11 12:00:00", seen=out.select("hash"))
    assert later.count() == 10 and rows(later, "headline")[0] == ("Headline number 20 about Acme",)


def test_loader_variant_keeps_undated_and_drops_near_copies(spark):
    df = spark.createDataFrame(
        [
            (0, "e", "Sales up 10% at the big company - Mint", "junk", "u"),
            (1, "e", "Sales up 12.5% at the BIG company! - Wire", "2024-01-02", "u"),
            (2, "e", "Another headline of good length", "2024-01-02", "u"),
        ],
        "position int, entity string, title string, pubDate string, link string",
    )
    out = G.ingest_feed_loader(df, [F.col("position")], as_of="2024-01-31")
    assert rows(out, "headline", "source", "date") == [
        ("Another headline of good length", "Google News", date(2024, 1, 2)),
        ("Sales up 10% at the big company", "Mint", date(2024, 1, 31)),
    ]


def test_labelled_text(spark, tmp_path):
    text = "a @ home@positive\nno label\n  caf\xe9 \"quoted, x\" @neutral \n"
    Path(tmp_path, "s.txt").write_bytes(text.encode("latin-1"))
    assert rows(L.parse_labelled_text(spark, str(tmp_path))) == [
        ("a @ home", "positive"),
        ('café "quoted, x"', "neutral"),
    ]


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_labelled_csv_finds_its_separator(spark, tmp_path, sep):
    lines = [f'neutral{sep}"line {i}{sep} caf\xe9"' for i in range(150)]
    Path(tmp_path, "d.csv").write_bytes("\n".join(lines).encode("latin-1"))
    out = L.scan_labelled_csv(spark, str(tmp_path))
    assert out.count() == 150
    assert out.filter(F.col("sentence") == f"line 7{sep} café").count() == 1


def test_labelled_csv_that_is_too_small(spark, tmp_path):
    Path(tmp_path, "d.csv").write_text("neutral,x\n" * 100)
    with pytest.raises(ValueError, match="100 lines"):
        L.scan_labelled_csv(spark, str(tmp_path))


def test_scan_headlines_checks_columns_and_path(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/t")
    with pytest.raises(ValueError, match="date, entity, headline, source, true_label"):
        L.scan_headlines(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError, match="nowhere"):
        L.scan_headlines(spark, f"{tmp_path}/nowhere")


def articles(spark, data):
    return spark.createDataFrame(data, "headline string, entity string, date date, source string")


A = ("Alpha headline of the day", "x", date(2024, 1, 1), "s")
B = ("Beta headline of the day", "x", date(2024, 1, 2), "s")
C = ("Gamma headline of the day", "y", date(2024, 1, 3), "s")


def test_insert_if_absent_keeps_twins_of_one_batch(spark, folder):
    store = TableStore(spark, folder)
    assert store.insert_articles(articles(spark, [A, A])) == 2
    assert store.insert_articles(articles(spark, [A, B])) == 1
    assert store.insert_articles(articles(spark, [A, B])) == 0
    assert store.insert_articles(articles(spark, [C]).withColumn("mood", F.lit("m"))) == 1
    assert rows(store.read("news_articles"), "headline", "mood") == [
        (A[0], None), (A[0], None), (B[0], None), (C[0], "m"),
    ]


def test_upsert_twice_equals_once(spark, folder):
    store = TableStore(spark, folder)
    base = articles(spark, [A, B]).withColumn("sentiment_score", F.lit(0.1))
    store.replace("scored_headlines", M.with_headline_hash(base))
    change = M.with_headline_hash(articles(spark, [B, C]).withColumn("sentiment_score", F.lit(0.9)))
    store.upsert_scores(change)
    once = rows(store.read("scored_headlines"), "headline", "sentiment_score")
    store.upsert_scores(change)
    assert rows(store.read("scored_headlines"), "headline", "sentiment_score") == once
    assert once == [(A[0], 0.1), (B[0], 0.9), (C[0], 0.9)]
    assert store.upsert_scores(change.limit(0)) is False


def test_empty_input_keeps_the_table_and_unmarked_versions_are_invisible(spark, folder):
    store = TableStore(spark, folder)
    table = articles(spark, [A])
    assert store.path("news_articles") is None and store.read("news_articles").count() == 0
    assert store.replace("news_articles", table)
    assert store.replace("news_articles", table.limit(0)) is False
    assert store.read("news_articles").count() == 1
    # An attempt that died before its marker: not visible, and overwritten by the next one.
    articles(spark, [B, C]).write.mode("overwrite").parquet(f"{folder}/news_articles/v=1")
    assert store.read("news_articles").count() == 1
    assert store.replace("news_articles", articles(spark, [C]))
    assert rows(store.read("news_articles"), "headline") == [(C[0],)]


def test_read_by_entity_and_health(spark, folder):
    store = TableStore(spark, folder)
    store.replace("news_articles", articles(spark, [A, B, C]))
    assert store.read("news_articles", "x").count() == 2
    assert store.read("temporal_risk", "x").count() == 0
    health = dict(rows(store.health()))
    assert health["news_articles"] == 3 and sum(health.values()) == 3 and len(health) == 6


def test_seen_keys_grow_once(spark):
    seen = spark.createDataFrame([("a",)], "hash string")
    new = spark.createDataFrame([("a",), ("b",), ("b",)], "hash string")
    assert rows(M.merge_seen(seen, new)) == [("a",), ("b",)]


def test_text_dates_are_coerced(spark):
    df = spark.createDataFrame([("2024-01-01",), ("x",)], "date string")
    assert rows(M.coerce_date(df)) == [(None,), (date(2024, 1, 1),)]


def by_length(df):
    share = (F.char_length("headline") % 10) / F.lit(10.0)
    return score_columns(df, F.array(share, F.lit(1.0) - share, F.lit(0.0)))


def test_run_against_stored_tables_equals_the_lazy_run(spark, folder):
    store = TableStore(spark, folder)
    texts = [f"Headline {'x' * (i % 9)} number {i}" for i in range(60)]
    data = [(t, f"e{i % 3}", date(2024, 1, 1 + i % 12), "s") for i, t in enumerate(texts)]
    batch = articles(spark, data).withColumn("true_label", F.lit(""))
    order = [F.col("headline")]
    first = batch.filter("date <= '2024-01-06'")
    refresh(store, first, by_length, order, "2024-01-12")
    result = refresh(store, batch, by_length, order, "2024-01-12")
    lazy = run_current(batch, by_length(first), by_length, order, "2024-01-12")
    assert rows(result.summary) == rows(lazy.summary) and result.summary.count() == 3
    assert rows(result.sources) == [("s", 60)]
    assert store.read("scored_headlines").count() == 60
    again = refresh(store, batch, by_length, order, "2024-01-12")
    assert rows(again.summary) == rows(lazy.summary)
    assert store.read("scored_headlines").count() == 60


def test_legacy_run_leaves_the_corpus_out(spark):
    raw = spark.createDataFrame(
        [
            ("Infosys wins a deal", date(2024, 1, 1), "phrasebank"),
            ("Infosys loses a deal", date(2024, 1, 2), None),
            ("Zomato delivers more", date(2024, 1, 2), "wire"),
        ],
        "headline string, date date, source string",
    )
    result = run_legacy(raw, by_length, "2024-01-31")
    assert rows(result.summary, "entity", "total_headlines") == [("Infosys", 1), ("Zomato", 1)]
    assert rows(result.sources, "source", "headlines") == [("wire", 1)]
    assert result.scored.count() == 3


def test_an_upsert_rewrites_only_the_folders_it_touches(spark, folder):
    schema = columns(k="string", n="long")
    table = KeyedTable(spark, f"{folder}/keyed", schema, ["k"], 16)
    frame = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    assert table.read().count() == 0 and table.upsert(frame()) == []
    assert len(table.upsert(frame(*[(f"k{i}", i) for i in range(200)]))) == 16
    before = set(table.read().inputFiles())
    computed = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            computed.add(batch.num_rows)
            yield batch

    change = frame(("k7", -7), ("k7", -8), ("new", 1)).mapInArrow(counted, schema)
    for _ in range(2):
        touched = table.upsert(change)
        assert 1 <= len(touched) <= 2
        after = set(table.read().inputFiles())
        gone = {f.split("/bucket=")[1].split("/")[0] for f in before ^ after}
        assert gone == {str(b) for b in touched}
    assert computed.value == 6  # once per upsert
    assert rows(table.lookup(frame(("k7", 0), ("new", 0), ("k9", 0), ("x", 0)))) == [("k7", -7), ("k7", -8), ("k9", 9), ("new", 1)]
    assert table.read().count() == 202
    missing = frame((None, 1))
    table.upsert(missing)
    assert table.read().filter("k is null").count() == 1


def test_the_separator_is_the_one_behind_a_label(spark, tmp_path):
    body = "".join(f"{'Positive' if i % 2 else 'neutral'};Profit rose, as expected, {i}\n" for i in range(200))
    (tmp_path / "labels.csv").write_text(body + "no label here, at all\n")
    out = L.scan_labelled_csv(spark, str(tmp_path))
    assert rows(out.filter("sentence like '% 7'")) == [("Positive", "Profit rose, as expected, 7")]
