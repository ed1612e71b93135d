"""What a messaging service hands out, as columns of the message model; and a Spark data source over any client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RECORD = "chat_id bigint, message_id bigint, posted_at timestamp, sender_id bigint, sender_name string, reply_to_message_id bigint, has_media boolean, text string, raw_json string"


def chat_type() -> Column:
    """Saved messages, else a broadcast channel, else a group, else a person by first or last name, else a group."""
    named = F.coalesce(F.nullif(F.trim("first_name"), F.lit("")), F.nullif(F.trim("last_name"), F.lit(""))).isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    return F.when(flag("is_self"), "saved").when(flag("broadcast"), "channel").when(flag("megagroup") | flag("gigagroup"), "group").when(named, "direct").otherwise("group")


def display_name(fallback: str = "Untitled") -> Column:
    """``Saved Messages``, the person's name, the title, or a fallback."""
    name = F.nullif(F.trim(F.concat_ws(" ", F.nullif(F.trim("first_name"), F.lit("")), F.nullif(F.trim("last_name"), F.lit("")))), F.lit(""))
    return F.when(F.coalesce(F.col("is_self"), F.lit(False)), "Saved Messages").otherwise(F.coalesce(name, F.nullif(F.trim("title"), F.lit("")), F.lit(fallback)))


def records(raw: DataFrame) -> DataFrame:
    """Raw payloads (``chat_id, raw_json``) as archive records: direction from the ``out`` flag, reply id and sender
    name from the first place that has one, image media by type or MIME."""
    get = lambda p: F.get_json_object("raw_json", p)
    first = lambda *ps: F.coalesce(*(get(p) for p in ps))
    name = F.nullif(F.trim(F.concat_ws(" ", get("$.sender.first_name"), get("$.sender.last_name"))), F.lit(""))
    return raw.select(
        "chat_id",
        get("$.id").try_cast("bigint").alias("message_id"),
        F.try_to_timestamp(get("$.date")).alias("posted_at"),
        F.try_to_timestamp(get("$.edit_date")).alias("edited_at"),
        first("$.sender_id", "$.from_id.user_id").try_cast("bigint").alias("sender_id"),
        F.coalesce(name, get("$.sender.title"), get("$.sender.username")).alias("sender_name"),
        F.when(F.lower(get("$.out")) == "true", "outgoing").otherwise("incoming").alias("direction"),
        first("$.reply_to_msg_id", "$.reply_to.reply_to_msg_id").try_cast("bigint").alias("reply_to_message_id"),
        get("$.media").isNotNull().alias("has_media"),
        F.coalesce(first("$.message", "$.text"), F.lit("")).alias("text"),
        is_image(get("$.media.type"), get("$.media.mime_type")).alias("is_image"),
        "raw_json",
    )


def is_image(media_type: Column, mime: Column) -> Column:
    return F.coalesce((media_type == "photo") | F.lower(mime).startswith("image/"), F.lit(False))


def image_extension(file_name: Column, mime: Column) -> Column:
    """From the file's name, else its MIME type, else ``.jpg``."""
    own = F.nullif(F.lower(F.regexp_extract(file_name, r"(\.[A-Za-z0-9]+)$", 1)), F.lit(""))
    kind = F.element_at(F.split(F.lower(mime), "/"), 2)
    return F.coalesce(own, F.when(kind == "jpeg", ".jpg").when(kind != "", F.concat(F.lit("."), kind)), F.lit(".jpg"))


class Chat(InputPartition):
    def __init__(self, chat_id: int):
        self.chat_id = chat_id


class MessageReader(DataSourceReader):
    """One partition for each chat; watermark, limit and order go to the client, as it can stop early."""

    def __init__(self, client: Callable, options: dict[str, str]):
        self.client, self.options = client, options

    def partitions(self) -> list[Chat]:
        return [Chat(int(c)) for c in self.options.get("chats", "").split(",") if c.strip()]

    def read(self, partition: Chat) -> Iterator[tuple]:
        limit = self.options.get("limit")
        yield from self.client(partition.chat_id, int(self.options.get("min_message_id", 0)), int(limit) if limit else None)


def message_source(client: Callable[[int, int, int | None], Iterator[tuple]], name: str = "messages") -> type[DataSource]:
    """A data source to register: ``client(chat_id, min_message_id, limit)`` yields rows of ``RECORD``."""

    class Messages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return RECORD

        def reader(self, schema) -> MessageReader:
            return MessageReader(client, dict(self.options))

    return Messages
