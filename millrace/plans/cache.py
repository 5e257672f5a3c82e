"""Content-addressed responses: files for single values, an anti-join for whole tables."""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ResponseCache:
    """Values by name and key; None is never a hit, and trouble with files never an error."""

    def __init__(self, folder: str, enabled: bool = True):
        self.folder, self.enabled = Path(folder), enabled

    def path(self, name: str, key) -> Path:
        text = json.dumps([key], sort_keys=True, ensure_ascii=False, default=repr)
        return self.folder / f"{name}_{hashlib.sha256(text.encode()).hexdigest()[:40]}.json"

    def get(self, name: str, key):
        if not self.enabled:
            return None
        with contextlib.suppress(OSError, ValueError, KeyError):
            return json.loads(self.path(name, key).read_text("utf-8"))["v"]
        return None

    def set(self, name: str, key, value) -> None:
        if not self.enabled:
            return
        with contextlib.suppress(OSError, TypeError):
            self.folder.mkdir(parents=True, exist_ok=True)
            body = json.dumps({"v": value}, ensure_ascii=False)
            with tempfile.NamedTemporaryFile("w", dir=self.folder, delete=False, encoding="utf-8") as f:
                f.write(body)
            os.replace(f.name, self.path(name, key))

    def cached(self, name: str, key, compute: Callable):
        found = self.get(name, key)
        if found is None:
            found = compute()
            self.set(name, key, found)
        return found

    def clear(self) -> None:
        for p in self.folder.glob("*.json") if self.folder.is_dir() else ():
            with contextlib.suppress(OSError):
                p.unlink()


def compute_missing(rows: DataFrame, known: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """key, value of all rows: those in ``known`` are looked up, the others computed once per distinct key."""
    asked = rows.select(key).distinct()
    found = asked.join(known.filter(F.col("value").isNotNull()).select(key, "value"), key)
    missing = rows.dropDuplicates([key]).join(known.filter(F.col("value").isNotNull()), key, "left_anti")
    return found.unionByName(compute(missing).select(key, "value"))
