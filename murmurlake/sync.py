"""Syncing chats into the archive, one after another, each on its own: a chat's failure leaves the others alone."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmurlake.functions.shared import written
from murmurlake.sources import archive

#: ``fetch(chat_id, after)`` gives the messages of a chat beyond an id.
Fetch = Callable[[int, int], DataFrame]
STATE = "chat_id bigint, last_message_id bigint, last_synced_at timestamp, last_status string, last_error string"


@dataclass(frozen=True)
class Result:
    chat_id: int
    status: str
    exported: int
    error: str | None = None


class Service:
    """Chats, messages and watermarks under one folder."""

    def __init__(self, spark: SparkSession, root: str, fetch: Fetch):
        self.spark, self.root, self.fetch = spark, root, fetch

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def messages(self) -> DataFrame | None:
        return self._read("messages")

    def states(self) -> DataFrame:
        found = self._read("state")
        return self.spark.createDataFrame([], STATE) if found is None else found

    def _state(self, chat_id: int) -> int:
        row = self.states().where(F.col("chat_id") == chat_id).first()
        return row.last_message_id if row else 0

    def _store_state(self, chat_id: int, last: int, status: str, error: str | None) -> None:
        row = self.spark.createDataFrame([(chat_id, last, None, status, error)], STATE).withColumn("last_synced_at", F.current_timestamp())
        rest = self.states().where(F.col("chat_id") != chat_id)
        written(rest.unionByName(row), "state").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/state")

    def store(self, batch: DataFrame) -> None:
        there = self.messages()
        chats = batch.select("chat_id").distinct()
        there = batch.limit(0) if there is None else there.join(F.broadcast(chats), "chat_id", "left_semi").select(*batch.columns)
        archive.write_archive(written(archive.upsert(there, batch), "merge"), f"{self.root}/messages")

    def sync(self, chat_ids: list[int], since: str | None = None) -> list[Result]:
        """Fetch what is beyond each watermark, store it, then move the watermark: never before."""
        out = []
        for chat in chat_ids:
            last = self._state(chat)
            try:
                batch = self.fetch(chat, last)
                batch = written(archive.since(batch, since) if since else batch, "fetched")
                seen = batch.agg(F.count("*"), F.max("message_id")).first()
                if seen[0]:
                    self.store(batch)
                self._store_state(chat, max(last, seen[1] or 0), "ok", None)
                out.append(Result(chat, "ok", seen[0]))
            except Exception as e:  # noqa: BLE001 - whatever fails in one chat is that chat's result
                self._store_state(chat, last, "error", str(e)[:500])
                out.append(Result(chat, "error", 0, str(e)[:500]))
        return out

    def backfill(self, chat_id: int, limit: int = 100) -> Result:
        """Store again the newest ``limit`` messages up to the watermark."""
        batch = self.fetch(chat_id, 0).where(F.col("message_id") <= self._state(chat_id)).orderBy(F.desc("message_id")).limit(limit)
        batch = written(batch, "fetched")
        if n := batch.count():
            self.store(batch)
        return Result(chat_id, "ok", n)

    def repair_media(self, chat_ids: list[int] | None = None) -> tuple[int, int]:
        """Fetch again the messages that lack media; how many were looked at and how many have it now."""
        there = self.messages()
        if there is None:
            return 0, 0
        lacking = archive.missing_media(there.withColumnRenamed("media_files", "media_refs")).select("chat_id", "message_id")
        lacking = written(lacking.where(F.col("chat_id").isin(*chat_ids)) if chat_ids else lacking, "lacking")
        repaired = 0
        for row in lacking.select("chat_id").distinct().orderBy("chat_id").collect():  # a row for each chat
            again = archive.by_ids(self.fetch(row.chat_id, 0), lacking).where(F.size("media_files") > 0)
            again = written(again, "repaired")
            if n := again.count():
                self.store(again)
                repaired += n
        return lacking.count(), repaired


def main(argv: list[str], service: Service, chats: DataFrame, out=sys.stdout) -> int:
    """``list-chats``, ``sync-all``, ``sync-chat``, ``backfill``, ``repair-media``; errors give exit code 1."""
    parser = argparse.ArgumentParser(prog="murmurlake")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list-chats")
    commands.add_parser("sync-all")
    commands.add_parser("sync-chat").add_argument("--chat", required=True)
    back = commands.add_parser("backfill")
    back.add_argument("--chat", required=True)
    back.add_argument("--limit", type=int, default=100)
    commands.add_parser("repair-media").add_argument("--chat")
    args = parser.parse_args(argv)
    one = lambda: archive.resolve_chat(chats, args.chat).first().chat_id
    try:
        if args.command == "list-chats":
            for c in chats.orderBy("chat_id").toLocalIterator():
                print(f"{c.chat_id}\t{c.chat_type}\t{c.title or ''}\t{'@' + c.username if c.username else ''}", file=out)
            return 0
        if args.command == "repair-media":
            print("scanned {} repaired {}".format(*service.repair_media([one()] if args.chat else None)), file=out)
            return 0
        if args.command == "backfill":
            if args.limit < 1:
                raise ValueError("the limit must be 1 at least")
            results = [service.backfill(one(), args.limit)]
        else:
            ids = [one()] if args.command == "sync-chat" else [r.chat_id for r in archive.filter_chats(chats).select("chat_id").orderBy("chat_id").collect()]
            results = service.sync(ids)
        for r in results:
            print(f"{r.chat_id} {r.status} {r.exported}" + (f" {r.error}" if r.error else ""), file=out)
        return int(any(r.status != "ok" for r in results))
    except ValueError as e:
        print(e, file=sys.stderr)
        return 1
