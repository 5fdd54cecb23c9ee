"""Landed events of a live run: folders by time slot, merged as they pile up, dropped when they are old.

What a batch may read is told by the manifest of the batch before it, a small file that names every live folder. A batch
writes new folders only and then its own manifest, so a batch that fails half way, or is run again, leaves no trace: its folders
are overwritten, and nothing else named them. Folders that a manifest gave up are deleted one batch later.

No folder is ever listed but that of the manifests, which holds two or three files, and the one a batch has just written. A slot has at most
FAN folders of each level: as many of one level are merged into one of the next.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from faultline.schema import cell_of

#: Folders of one level in a slot that are merged into one of the next level.
FAN = 16


class Store:
    """Small files and folders in shared storage, through the file systems Spark knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark.sparkContext._jvm, root
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Write under another name first, so that a reader never sees half a file."""
        self.delete(f"{name}.new")
        out = self.fs.create(self.path(f"{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        self.delete(name)
        self.fs.rename(self.path(f"{name}.new"), self.path(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


@dataclass
class Folder:
    """A folder of landed rows: its slot of time, how often its rows were merged, its name."""

    slot: int
    level: int
    name: str


@dataclass
class Manifest:
    """The state after a batch: live folders, what the next batch goes on from, and what it may delete."""

    batch: int = -1
    slot_us: int = 0
    next_seq: int = 0
    high_us: int | None = None
    start_us: int | None = None
    rows: int = 0
    late: int = 0
    known: str | None = None
    folders: list[Folder] = field(default_factory=list)
    dropped: list[str] = field(default_factory=list)

    @staticmethod
    def parse(text: str) -> Manifest:
        raw = json.loads(text)
        raw["folders"] = [Folder(**f) for f in raw["folders"]]
        return Manifest(**raw)


class Landing:
    """The landed events of a live run under `root`."""

    def __init__(self, spark: SparkSession, root: str, slot_us: int):
        self.spark, self.root, self.slot_us = spark, root, slot_us
        self.store = Store(spark, root)

    def before(self, batch: int) -> Manifest:
        """The manifest of the last batch before this one."""
        numbers = [int(n) for n in self.store.names("manifests") if n.isdigit()]
        earlier = [n for n in numbers if n < batch]
        if not earlier:
            return Manifest(slot_us=self.slot_us)
        found = Manifest.parse(self.store.read(f"manifests/{max(earlier)}"))
        self.slot_us = found.slot_us  # slots keep the width they were written with
        return found

    def land(self, rows: DataFrame, batch: int) -> list[Folder]:
        """Write a batch's rows by slot; few files a slot, a large slot in several."""
        name = f"landed/{batch}"
        placed = rows.withColumns({"batch": F.lit(batch), "slot": cell_of(F.unix_micros("ts"), self.slot_us)})
        placed.hint("rebalance", "slot").write.mode("overwrite").partitionBy("slot").parquet(f"{self.root}/{name}")
        # Rows without a time have no place in the log.
        slots = [n for n in self.store.names(name) if n.startswith("slot=") and not n.startswith("slot=__")]
        return [Folder(int(n[5:]), 0, f"{name}/{n}") for n in sorted(slots)]

    def read(self, folders: list[Folder], schema: StructType, first: int, last: int) -> DataFrame:
        """The rows of the slots from first to last; their folders are named one by one."""
        return self.rows([f for f in folders if first <= f.slot <= last], schema)

    def rows(self, folders: list[Folder], schema: StructType) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f.name}" for f in folders])

    def merge(self, folders: list[Folder], batch: int, schema: StructType) -> tuple[list[Folder], list[str]]:
        """Merge FAN folders of a slot and level into one of the next level: (live folders, names given up)."""
        live, given_up, again = list(folders), [], True
        while again:
            again, piles = False, {}
            for f in live:
                piles.setdefault((f.slot, f.level), []).append(f)
            for (slot, level), pile in piles.items():
                if len(pile) >= FAN:
                    into = Folder(slot, level + 1, f"landed/{batch}-{level + 1}/slot={slot}")
                    self.rows(pile, schema).hint("rebalance").write.mode("overwrite").parquet(f"{self.root}/{into.name}")
                    live = [f for f in live if f not in pile] + [into]
                    given_up += [f.name for f in pile]
                    again = True
        return live, given_up

    def retire(self, folders: list[Folder], high_us: int, retain_us: int) -> tuple[list[Folder], list[str]]:
        """Give up the slots that ended more than `retain_us` before `high_us`."""
        old = [f for f in folders if (f.slot + 1) * self.slot_us <= high_us - retain_us]
        return [f for f in folders if f not in old], [f.name for f in old]

    def commit(self, now: Manifest, before: Manifest) -> None:
        """Make the batch count, then delete what the batch before gave up."""
        self.store.write(f"manifests/{now.batch}", json.dumps(asdict(now)))
        for name in before.dropped:
            if name not in {f.name for f in now.folders} and name != now.known:
                self.store.delete(name)
        for n in self.store.names("manifests"):
            if n.isdigit() and int(n) < before.batch:
                self.store.delete(f"manifests/{n}")
