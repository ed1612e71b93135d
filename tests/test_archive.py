"""Archive: upserts, watermarks, chat selection, legacy readers, streaming ingest, the sync service, the entry."""

import io
import json
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from murmurlake.functions.shared import shared_folder
from murmurlake.sources import archive, provider
from murmurlake.streaming import ingest
from murmurlake.sync import Service, main

ROW = "chat_id bigint, message_id bigint, text string, position bigint"
FULL = "chat_id bigint, message_id bigint, posted_at timestamp, has_media boolean, media_files array<string>, text string, position bigint"


def test_upsert_keeps_places(spark):
    one = spark.createDataFrame([(1, 2, "old", 0)], ROW)
    two = spark.createDataFrame([(1, 1, "new", 0), (1, 2, "first edit", 1), (1, 2, "last edit", 2)], ROW)
    got = sorted(archive.upsert(one, two).collect(), key=lambda r: r.position)
    assert [(r.message_id, r.text) for r in got] == [(2, "last edit"), (1, "new")]
    assert sorted(r.message_id for r in archive.upsert(one.limit(0), two).collect()) == [1, 2]
    assert archive.upsert(one, two.limit(0)).collect() == one.collect()


def test_payload_round_trip(spark):
    payload = json.dumps({"message_id": 5, "posted_at": "2026-01-01T10:00:00Z", "media_files": [{"relative_path": "a"}]})
    (r,) = archive.decode(spark.createDataFrame([(1, 0, payload)], "chat_id bigint, position bigint, payload string")).collect()
    assert (r.direction, r.text, r.media_files[0].media_type, r.posted_at) == ("incoming", "", "file", datetime(2026, 1, 1, 10))
    again = archive.encode(archive.decode(spark.createDataFrame([(1, 0, payload)], "chat_id bigint, position bigint, payload string"))).first()
    assert json.loads(again.payload)["posted_at"] == "2026-01-01T10:00:00Z"


def test_chats(spark):
    chats = spark.createDataFrame([(1, "direct", "Ann", "ann", "ann"), (2, "group", "Markets", None, "markets"), (3, "channel", "News", "News", "news")], "chat_id bigint, chat_type string, title string, username string, slug string")
    assert archive.filter_chats(chats, exclude=("markets", "@news")).collect() == []
    assert [r.chat_id for r in archive.filter_chats(chats, include=("@News",)).collect()] == [3]
    assert archive.resolve_chat(chats, " @ANN ").first().chat_id == 1
    with pytest.raises(ValueError):
        archive.resolve_chat(chats, "nobody")
    who = spark.createDataFrame([(True, False, False, False, "a", None, None), (False, True, False, False, None, None, "T"), (False, False, True, False, None, None, ""), (None, None, None, None, " A ", "B", None)], "is_self boolean, broadcast boolean, megagroup boolean, gigagroup boolean, first_name string, last_name string, title string")
    assert [tuple(r) for r in who.select(provider.chat_type(), provider.display_name()).collect()] == [("saved", "Saved Messages"), ("channel", "T"), ("group", "Untitled"), ("direct", "A B")]


def test_watermarks(spark):
    state = spark.createDataFrame([(1, 10)], "chat_id bigint, last_message_id bigint")
    rows = spark.createDataFrame([(1, 9), (1, 11), (2, 3)], "chat_id bigint, message_id bigint")
    new = archive.new_messages(rows, state)
    assert sorted(map(tuple, new.collect())) == [(1, 11), (2, 3)]
    assert sorted(map(tuple, archive.advance(state, new).collect())) == [(1, 11, 1), (2, 3, 1)]


def test_legacy_stores(spark, tmp_path):
    assert archive.read_legacy(spark, str(tmp_path), 1) is None
    (tmp_path / "messages.json").write_text(json.dumps({"messages": [{"message_id": 1}, "odd", {"message_id": 2}]}))
    assert [json.loads(r.payload)["message_id"] for r in archive.read_legacy(spark, str(tmp_path), 7).collect()] == [1, 2]
    db = sqlite3.connect(tmp_path / "messages.sqlite3")
    db.execute("CREATE TABLE messages (message_id INTEGER, position INTEGER, payload TEXT)")
    db.execute("""INSERT INTO messages VALUES (3, 0, '{"message_id": 3}')""")
    db.commit()
    db.close()
    assert [(r.chat_id, r.payload) for r in archive.read_legacy(spark, str(tmp_path), 7).collect()] == [(7, '{"message_id": 3}')]
    folder = tmp_path / "chats" / "group" / "g-1"
    folder.mkdir(parents=True)
    (folder / "_state.json").write_text('{"chat_id": 4, "last_message_id": 9}')
    (r,) = archive.discover_chats(spark, str(tmp_path / "chats")).collect()
    assert (r.chat_id, r.chat_type, r.slug, r.last_message_id, r.last_status) == (4, "group", "g-1", 9, "never")
    (tmp_path / ".env").write_text("# c\nA=1\n\nnothing\nB='x'\n")
    assert archive.load_settings(str(tmp_path / ".env"), {"A": "0", "C": "2"}) == {"A": "1", "B": "x", "C": "2"}
    assert archive.parse_object('```json\n{"a": 1}\n```') == {"a": 1} and archive.parse_object("none") == {}


def test_stream_ingest(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "cp"))
    spark.createDataFrame([(1, 1, "a", 0), (2, 1, "b", 0)], ROW).write.parquet(source)
    schema = spark.read.parquet(source).schema
    ingest.ingest(ingest.stream_messages(spark, source, schema), out, checkpoint).awaitTermination()
    spark.createDataFrame([(1, 1, "edited", 5), (1, 2, "c", 6)], ROW).write.mode("append").parquet(source)
    ingest.ingest(ingest.stream_messages(spark, source, schema), out, checkpoint).awaitTermination()
    got = {(r.chat_id, r.message_id): r.text for r in spark.read.parquet(out).collect()}
    assert got == {(1, 1): "edited", (1, 2): "c", (2, 1): "b"}


def test_stream_cadence(spark, tmp_path):
    rows = [(1, i, datetime(2026, 1, 1, 5 + i // 3, i), i % 2 == 0) for i in range(6)]
    spark.createDataFrame(rows, "chat_id bigint, message_id bigint, timestamp timestamp, has_media boolean").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = ingest.windowed_cadence(ingest.distinct_messages(stream), late=None).writeStream.outputMode("append").format("memory").queryName("cadence").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.start.hour: r.messages for r in spark.sql("select * from cadence").collect()}.items() <= {5: 3, 6: 3}.items()


def test_sync_service(spark, tmp_path):
    rows = [(1, 1, datetime(2026, 1, 1), True, [], "a", 0), (1, 2, datetime(2026, 1, 2), False, [], "b", 1)]

    def fetch(chat, after):
        if chat == 13:
            raise OSError("unlucky")
        return spark.createDataFrame(rows, FULL).where((F.col("chat_id") == chat) & (F.col("message_id") > after))

    service = Service(spark, str(tmp_path / "a"), fetch)
    assert [(r.chat_id, r.status, r.exported) for r in service.sync([1, 13])] == [(1, "ok", 2), (13, "error", 0)]
    assert [(r.status, r.exported) for r in service.sync([1])] == [("ok", 0)]
    assert {r.chat_id: (r.last_message_id, r.last_status) for r in service.states().collect()} == {1: (2, "ok"), 13: (0, "error")}
    rows[0] = (*rows[0][:4], ["photo.jpg"], "a", 0)
    assert service.repair_media() == (1, 1) and service.repair_media() == (0, 0)
    assert service.backfill(1, 1).exported == 1 and service.messages().count() == 2
    other = Service(spark, str(tmp_path / "b"), fetch)
    assert other.sync([1], since="2026-01-02")[0].exported == 1
    chats = spark.createDataFrame([(1, "group", "G", None, "g"), (13, "group", "H", None, "h")], "chat_id bigint, chat_type string, title string, username string, slug string")
    out = io.StringIO()
    assert main(["list-chats"], other, chats, out) == 0 and main(["sync-all"], other, chats, out) == 1 and main(["sync-chat", "--chat", "g"], other, chats, out) == 0
    assert main(["backfill", "--chat", "g", "--limit", "0"], other, chats, out) == 1 and main(["sync-chat", "--chat", "zz"], other, chats, out) == 1
    assert "1 ok" in out.getvalue() and "13 error" in out.getvalue()


def test_data_source(spark):
    def client(chat, after, limit):
        for i in range(after + 1, after + 1 + (limit or 3)):
            yield (chat, i, datetime(2026, 1, 1), 1, "n", None, False, "t", "{}")

    spark.dataSource.register(provider.message_source(client))
    df = spark.read.format("messages").option("chats", "1, 2").option("min_message_id", 10).option("limit", 2).load()
    assert sorted((r.chat_id, r.message_id) for r in df.collect()) == [(1, 11), (1, 12), (2, 11), (2, 12)]
    raw = spark.createDataFrame([(1, '{"id": 4, "date": "2026-01-01T00:00:00", "out": true, "message": "hi", "reply_to": {"reply_to_msg_id": 2}, "media": {"mime_type": "image/png"}}')], "chat_id bigint, raw_json string")
    (r,) = provider.records(raw).collect()
    assert (r.message_id, r.direction, r.reply_to_message_id, r.is_image, r.text) == (4, "outgoing", 2, True, "hi")


def test_shared_folder_follows_the_session(spark):
    class Conf:
        def get(self, name, default=None):
            return "file:///shared/place" if name == "spark.checkpoint.dir" else default

    class Session:
        conf = Conf()

    assert shared_folder(Session()) == "file:///shared/place"
    assert shared_folder(spark) == shared_folder(spark)


def test_entry_and_registry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
