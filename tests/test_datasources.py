import datetime as dt
import json

import pytest

from regdelta.sources import datasources as S
from regdelta.sources.landing import feed_items_to_documents

FEED = """<rss version="2.0"><channel><title>Notices</title><item><title>A rule on steel</title><link>https://x.org/{d}</link><description>Importers &amp; others have to file</description><guid>g{d}</guid></item>
<item><title>Second</title><link>https://x.org/b{d}</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom news</title><entry><title>Entry</title><link href="https://y.org/1"/><id>i1</id><updated>2024-01-03</updated><summary>Some words of it</summary></entry></feed>"""


@pytest.fixture(scope="module")
def formats(spark):
    S.register_formats(spark)
    return spark


def test_register_pages_by_day(formats, tmp_path, monkeypatch):
    for d in range(1, 6):
        rows = [{"document_number": f"{d}-{i}", "title": "t", "agencies": [{"raw_name": "CBP"}, None], "extra": 1} for i in range(3)]
        (tmp_path / f"2024-01-0{d}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "readme.txt").write_text("not a day")
    all_days = formats.read.format("register_index").load(str(tmp_path))
    assert all_days.count() == 15 and all_days.rdd.getNumPartitions() == 5
    two = all_days.where("day >= date'2024-01-04' and title = 't'")
    assert two.rdd.getNumPartitions() == 2 and {r.document_number[0] for r in two.collect()} == {"4", "5"}
    assert all_days.where("day in (date'2024-01-01', date'2024-01-03')").select("agencies").first()[0] == ["CBP", None]


def test_filters_that_are_not_on_the_day_go_back(tmp_path):
    (tmp_path / "2024-01-02.jsonl").write_text("")
    reader = S.RegisterSource({"path": str(tmp_path)}).reader(type("Schema", (), {"fieldNames": staticmethod(lambda: ["day"])})())
    keep = S.EqualTo(("title",), "t")
    assert list(reader.pushFilters([keep, S.LessThan(("day",), dt.date(2024, 1, 2))])) == [keep] and reader.partitions() == []


def test_broken_line_is_named(formats, tmp_path):
    (tmp_path / "2024-01-02.jsonl").write_text('{"title": "a"}\n{broken\n')
    with pytest.raises(Exception, match="line 2"):
        formats.read.format("register_index").load(str(tmp_path)).collect()


def test_feeds_land_as_documents(formats, tmp_path):
    (tmp_path / "2024-01-02-a.xml").write_text(FEED.format(d=2))
    (tmp_path / "2024-01-03.xml").write_text(ATOM)
    items = formats.read.format("feed_index").load(str(tmp_path))
    assert [(r.feed_title, r.pos, r.title, r.link, r.guid) for r in items.orderBy("day", "pos").collect()] == [
        ("Notices", 0, "A rule on steel", "https://x.org/2", "g2"), ("Notices", 1, "Second", "https://x.org/b2", None), ("Atom news", 0, "Entry", "https://y.org/1", "i1"),
    ]
    docs = feed_items_to_documents(items).collect()
    assert {d.source_url for d in docs} == {"https://x.org/2", "https://x.org/b2", "https://y.org/1"}


def test_stream_goes_on_after_its_offset(formats, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()

    def run():
        rows = formats.readStream.format("feed_index").load(str(folder)).select("day", "title")
        rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(out).awaitTermination(120)
        return formats.read.parquet(out).count()

    (folder / "2024-01-02.xml").write_text(FEED.format(d=2))
    assert run() == 2
    (folder / "2024-01-03.xml").write_text(ATOM)
    assert run() == 3 and run() == 3
