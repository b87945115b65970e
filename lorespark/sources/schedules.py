"""Schedule intents in a small JSON file. Nothing here runs them."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespark.functions.schedule import valid_cron, valid_timezone
from lorespark.functions.text import sensitive
from lorespark.sources.shared import file_system

FIELDS = {"id", "command", "cron", "timezone", "enabled", "source_id"}
MOST_BYTES = 1 << 20


def problems(spark: SparkSession, intent: dict) -> list[str]:
    """What is wrong with an intent; empty if nothing is."""
    out = [f"unknown field {k}" for k in sorted(set(intent) - FIELDS)]
    if not re.fullmatch(r"[A-Za-z0-9][\w.-]{0,127}", str(intent.get("id", ""))):
        out.append("id")
    if intent.get("command") not in ("update", "ingest"):
        out.append("command")
    if not isinstance(intent.get("cron"), str) or not valid_cron(intent["cron"]):
        out.append("cron")
    if "timezone" in intent and not valid_timezone(str(intent["timezone"])):
        out.append("timezone")
    if not isinstance(intent.get("enabled"), bool):
        out.append("enabled")
    if (intent.get("command") == "ingest") != ("source_id" in intent):
        out.append("source_id")
    if spark.range(1).select(F.coalesce(sensitive(F.lit(json.dumps(intent))), F.lit(False))).first()[0]:
        out.append("a secret")
    return out


class ScheduleStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.fs, self.at = file_system(spark, path)

    def list(self) -> list[dict]:
        """In the order of ids; none where there is no file."""
        if not self.fs.exists(self.at):
            return []
        if self.fs.getFileStatus(self.at).getLen() > MOST_BYTES:
            raise ValueError("the schedule file is too large")
        return json.loads("".join(r[0] for r in self.spark.read.text(self.path, wholetext=True).collect()))["schedules"]

    def table(self) -> DataFrame:
        return self.spark.createDataFrame([tuple(s.get(k) for k in ("id", "command", "cron", "timezone", "enabled", "source_id")) for s in self.list()], "id string, command string, cron string, timezone string, enabled boolean, source_id string")

    def set(self, intent: dict) -> bool:
        """Adds or replaces an intent by its id; whether that changed anything."""
        if wrong := problems(self.spark, intent):
            raise ValueError("schedule: " + ", ".join(wrong))
        now = {s["id"]: s for s in self.list()}
        if now.get(intent["id"]) == intent:
            return False
        self._write(now | {intent["id"]: intent})
        return True

    def remove(self, id_: str) -> bool:
        now = {s["id"]: s for s in self.list()}
        if id_ not in now:
            return False
        self._write({k: v for k, v in now.items() if k != id_})
        return True

    def _write(self, schedules: dict[str, dict]) -> None:
        from lorespark.sources.store import replace_file

        replace_file(self.spark, self.path, json.dumps({"schedules": [schedules[k] for k in sorted(schedules)]}).encode())
