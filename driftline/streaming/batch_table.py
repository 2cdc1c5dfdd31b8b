"""A table that a stream's batches add to and that stays small in folders.

Each batch is a folder. As soon as a level has ``FAN`` folders they are merged to one of the next level, so a table of n
batches has about ``FAN`` * log(n) folders, and each row is written again log(n) times. Which folders make up the table
stands in a pointer file; a new state is a new pointer file of the next number, put in place by one rename. Readers take the
pointer file of the highest number. Folders that were merged stay until ``GRACE`` more states have followed, so a reader of
an earlier state still finds its files.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: folders of a level that are merged to one
FAN = 8
#: states for which the folders of an earlier state are kept
GRACE = 16


class BatchTable:
    """The table at ``path``; ``merge`` reduces rows of several batches, ``by`` are its partition columns.

    There is one writer, the stream. ``merge`` must give the same for all rows at once as for merged parts.
    """

    def __init__(self, spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame] | None = None,
                 by: list[str] | None = None, fan: int = FAN, grace: int = GRACE):
        self.spark, self.path, self.by, self.fan, self.grace = spark, path.rstrip("/"), by or [], fan, grace
        self.merge = merge or (lambda rows: rows)

    def _at(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *names]))

    def _files(self):
        return self._at("states").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        """The numbers of all pointer files, ascending."""
        files, folder = self._files(), self._at("states")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n[:-len(".json")]) for n in names if n.endswith(".json") and not n.startswith("."))

    def _state(self, number: int) -> dict:
        stream = self._files().open(self._at("states", f"{number:012d}.json"))
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def state(self) -> dict:
        """The present state: ``number``, the last ``batch`` in it, and ``folders`` as (level, name)."""
        numbers = self._numbers()
        return self._state(numbers[-1]) if numbers else {"number": 0, "batch": -1, "folders": []}

    def _publish(self, state: dict) -> None:
        files = self._files()
        new, place = self._at("states", f".{uuid.uuid4().hex}"), self._at("states", f"{state['number']:012d}.json")
        stream = files.create(new, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if files.exists(place) or not files.rename(new, place):
            raise RuntimeError(f"another writer has put {place.toString()}")

    def append(self, batch: DataFrame, number: int) -> None:
        """Add a batch; one whose number the table has seen already is left out, since it holds the same rows."""
        state = self.state()
        if number <= state["batch"]:
            return
        name = f"0-{number}"
        self._write(batch, name)
        state = {"number": state["number"] + 1, "batch": number, "folders": [*state["folders"], [0, name]],
                 "schema": batch.schema.jsonValue()}
        self._publish(state)
        while (state := self._merged(state)) is not None:
            self._publish(state)
        self._clear()

    def _write(self, rows: DataFrame, name: str) -> None:
        writer = rows.write.mode("overwrite")
        (writer.partitionBy(*self.by) if self.by else writer).parquet(f"{self.path}/data/set={name}")

    def _merged(self, state: dict) -> dict | None:
        """The state once the lowest full level is one folder of the next; None if no level is full."""
        for level in sorted({level for level, _ in state["folders"]}):
            full = [name for at, name in state["folders"] if at == level]
            if len(full) >= self.fan:
                rows = self.merge(self._read(full, state))
                name = f"{level + 1}-{state['number']}"
                self._write(rows.repartition(*self.by) if self.by else rows, name)
                kept = [f for f in state["folders"] if f[0] != level]
                return {**state, "number": state["number"] + 1, "folders": [*kept, [level + 1, name]]}
        return None

    def _clear(self) -> None:
        """Remove pointer files that are over the grace, and folders that no pointer file left names."""
        numbers, files = self._numbers(), self._files()
        old, left = numbers[:-self.grace], numbers[-self.grace:]
        if not old:
            return
        named = {name for n in left for _, name in self._state(n)["folders"]}
        gone = {name for n in old for _, name in self._state(n)["folders"]} - named
        for name in gone:
            files.delete(self._at("data", f"set={name}"), True)
        for n in old:  # after the folders: an interrupted clearing is taken up by the next one
            files.delete(self._at("states", f"{n:012d}.json"), False)

    def _read(self, names: list[str], state: dict) -> DataFrame:
        folders = [f"{self.path}/data/set={name}" for name in names]
        # the schema is given, so no file is opened for it, and a batch without rows may have no file
        schema = T.StructType.fromJson(state["schema"])
        read = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*folders)
        return read.select(*schema.names)

    def read(self) -> DataFrame:
        """The merged rows of all batches so far."""
        state = self.state()
        if not state["folders"]:
            raise ValueError(f"{self.path} holds no batch yet")
        return self.merge(self._read([name for _, name in state["folders"]], state))
