"""The message archive: keyed upserts, watermarks, chat selection, legacy readers, and sinks."""

from __future__ import annotations

import json
import sqlite3
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PAYLOAD = "message_id bigint, posted_at string, edited_at string, sender_id bigint, sender_name string, direction string, reply_to_message_id bigint, has_media boolean, text string, media_files array<struct<media_type:string,relative_path:string,mime_type:string,file_name:string>>"
KEYS = ["chat_id", "message_id"]


def decode(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``chat_id, position, payload`` with the JSON payload as columns: direction ``incoming``, text empty, media type
    ``file`` where missing; times as timestamps."""
    out = rows.withColumn("p", F.from_json(payload, PAYLOAD)).select("chat_id", "position", "p.*")
    media = F.transform(F.coalesce("media_files", F.array().cast("array<struct<media_type:string,relative_path:string,mime_type:string,file_name:string>>")), lambda m: F.struct(F.coalesce(m["media_type"], F.lit("file")).alias("media_type"), m["relative_path"].alias("relative_path"), m["mime_type"].alias("mime_type"), m["file_name"].alias("file_name")))
    return out.withColumns({"direction": F.coalesce("direction", F.lit("incoming")), "text": F.coalesce("text", F.lit("")), "media_files": media, "posted_at": F.to_timestamp("posted_at"), "edited_at": F.to_timestamp("edited_at"), "has_media": F.coalesce("has_media", F.lit(False))})


def encode(records: DataFrame) -> DataFrame:
    """Records as ``chat_id, message_id, position, payload``."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(c)
    fields = [iso(c) if c in ("posted_at", "edited_at") else F.col(c) for c in (x.split()[0] for x in PAYLOAD.split(", ") if " " in x) if c in records.columns]
    return records.select("chat_id", "message_id", "position", F.to_json(F.struct(*fields)).alias("payload"))


def upsert(existing: DataFrame, batch: DataFrame, keys: list[str] = KEYS, position: str = "position") -> DataFrame:
    """Both tables merged: the last write of a key wins (the batch over what is there; in the batch the later
    position), and a key keeps the place where it first stood. New keys follow after the last place, in their order."""
    columns = [c for c in existing.columns if c != position]
    both = existing.select(*columns, F.col(position).alias("__at"), F.lit(0).alias("__batch")).unionByName(batch.select(*columns, F.col(position).alias("__at"), F.lit(1).alias("__batch")))
    w = Window.partitionBy(*keys)
    ranked = both.withColumns({"__place": F.row_number().over(w.orderBy(F.desc("__batch"), F.desc("__at"))), "__first": F.min(F.struct("__batch", "__at")).over(w)})
    last = F.broadcast(existing.agg(F.coalesce(F.max(position) + 1, F.lit(0)).alias("__last")))
    start = F.broadcast(batch.agg(F.coalesce(F.min(position), F.lit(0)).alias("__start")))
    placed = ranked.where("__place = 1").crossJoin(last).crossJoin(start)
    at = F.when(F.col("__first.__batch") == 0, F.col("__first.__at")).otherwise(F.col("__last") + F.col("__first.__at") - F.col("__start"))
    return placed.select(*columns, at.cast("bigint").alias(position))


def write_archive(records: DataFrame, path: str) -> None:
    """Replace the partitions of the chats that ``records`` holds; others stay."""
    records.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chat_id").parquet(path)


def new_messages(messages: DataFrame, state: DataFrame) -> DataFrame:
    """Messages beyond their chat's watermark; all of a chat without one."""
    return messages.join(state.select("chat_id", "last_message_id"), "chat_id", "left").where(F.col("message_id") > F.coalesce("last_message_id", F.lit(0))).drop("last_message_id")


def advance(state: DataFrame, written_: DataFrame) -> DataFrame:
    """Watermarks after ``written_`` has been stored: they never go back, and only what was stored moves them."""
    seen = written_.groupBy("chat_id").agg(F.max("message_id").alias("seen"), F.count("*").alias("exported"))
    return state.select("chat_id", "last_message_id").join(seen, "chat_id", "full_outer").select("chat_id", F.greatest(F.coalesce("last_message_id", F.lit(0)), F.coalesce("seen", F.lit(0))).alias("last_message_id"), F.coalesce("exported", F.lit(0)).alias("exported"))


def selectors() -> Column:
    """What a chat can be named by: id, slug, title, user name with and without ``@``, in lower case."""
    names = [F.col("chat_id").cast("string"), "slug", "title", "username", F.concat(F.lit("@"), F.col("username"))]
    lowered = F.transform(F.array(*names), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(lowered, lambda x: x.isNotNull() & (x != "")))


def filter_chats(chats: DataFrame, types: tuple[str, ...] = ("group", "channel", "saved"), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """Chats of the types, named by ``include`` (if any), not named by ``exclude``."""
    array = lambda xs: F.array(*(F.lit(x.strip().lower()) for x in xs)).cast("array<string>")
    out = chats.where(F.col("chat_type").isin(*types))
    if include:
        out = out.where(F.arrays_overlap(selectors(), array(include)))
    return out.where(~F.arrays_overlap(selectors(), array(exclude))) if exclude else out


def resolve_chat(chats: DataFrame, selector: str) -> DataFrame:
    """The first chat, in order of id, that a selector names; an error if there is none."""
    name = selector.strip().lower().removeprefix("@")
    found = chats.where(F.array_contains(selectors(), name)).orderBy("chat_id").limit(1)
    if found.isEmpty():
        raise ValueError(f"no chat is named {selector!r}")
    return found


def missing_media(messages: DataFrame) -> DataFrame:
    """Messages that should have media and have none."""
    return messages.where(F.col("has_media") & (F.size(F.coalesce("media_refs", F.array().cast("array<string>"))) == 0))


def since(messages: DataFrame, moment: str, time: str = "posted_at") -> DataFrame:
    """Messages from a date or an ISO time on."""
    return messages.where(F.col(time) >= F.lit(moment).cast("timestamp"))


def by_ids(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """The messages that ``ids`` (key columns) names."""
    return messages.join(ids, KEYS, "left_semi")


def read_sqlite(spark: SparkSession, path: str) -> DataFrame:
    """A local archive database as ``chat_id, message_id, position, payload``: a one-off import."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        columns = {r[1] for r in db.execute("PRAGMA table_info(messages)")}
        chat = "chat_id" if "chat_id" in columns else "NULL"
        rows = db.execute(f"SELECT {chat}, message_id, position, payload FROM messages ORDER BY position").fetchall()
    return spark.createDataFrame(rows, "chat_id bigint, message_id bigint, position bigint, payload string")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """A cache file ``{"messages": [...]}`` as ``position, payload``; entries that aren't objects are skipped."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", "messages array<string>")["messages"]
    return whole.select(F.posexplode(items).alias("position", "payload")).where(F.ltrim("payload").startswith("{")).select(F.col("position").cast("bigint").alias("position"), "payload")


def read_legacy(spark: SparkSession, folder: str, chat_id: int) -> DataFrame | None:
    """A chat's old store: the database if it is there, else the JSON cache, else nothing."""
    root = Path(folder)
    if (root / "messages.sqlite3").exists():
        return read_sqlite(spark, str(root / "messages.sqlite3")).withColumn("chat_id", F.coalesce("chat_id", F.lit(chat_id).cast("bigint"))).select("chat_id", "position", "payload")
    if (root / "messages.json").exists():
        return read_json_cache(spark, str(root / "messages.json")).select(F.lit(chat_id).cast("bigint").alias("chat_id"), "position", "payload")
    return None


def discover_chats(spark: SparkSession, root: str, types: tuple[str, ...] = ("direct", "group", "channel", "saved")) -> DataFrame:
    """Chats from ``<root>/<type>/<slug>/_state.json``; unknown types are skipped."""
    rows = []  # a small file for each chat; Spark's own listing passes over names that begin with an underscore
    for file in sorted(Path(root).glob("*/*/_state.json")):
        if file.parts[-3] in types:
            state = parse_object(file.read_text())
            rows.append((state.get("chat_id"), file.parts[-3], file.parts[-2], state.get("last_message_id") or 0, state.get("last_synced_at"), state.get("last_status") or "never", state.get("last_error")))
    return spark.createDataFrame(rows, "chat_id bigint, chat_type string, slug string, last_message_id bigint, last_synced_at string, last_status string, last_error string")


def chat_note(chats: DataFrame) -> DataFrame:
    """Each chat as a note with front matter, one string."""
    line = lambda k: F.concat(F.lit(f"{k}: "), F.coalesce(F.to_json(F.struct(F.col(k).alias("v"))), F.lit("null")))
    return chats.select("chat_id", F.concat_ws("\n", F.lit("---"), *(line(k) for k in ("chat_id", "chat_type", "slug", "title")), F.lit("---"), F.concat(F.lit("# "), F.coalesce("title", "slug"))).alias("note"))


def load_settings(path: str, environment: dict[str, str]) -> dict[str, str]:
    """Settings of a ``NAME=value`` file over those of the environment; comments and blank lines are skipped."""
    out = dict(environment)
    if Path(path).exists():
        for raw in Path(path).read_text().splitlines():
            name, found, value = raw.strip().partition("=")
            if found and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("\"'")
    return out


def parse_object(text: str) -> dict:
    """A JSON object out of a model's reply: without its code fence, or what its outermost braces hold, else empty."""
    start, end = text.find("{"), text.rfind("}")
    try:
        found = json.loads(text[start : end + 1]) if start >= 0 else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}
