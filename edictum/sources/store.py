"""The step store: states under ``steps/<id>`` and a pointer to the current one.

A step is committed by switching the pointer, and by nothing else.  Its tables and its
digest are written before; the pointer names the step, its digest, the step before it and
how many came before.  Once a later step has been committed the earlier one has a mark,
written before the pointer moves on, so whether a step is committed is known without a walk.
Recovery keeps what the pointer names (and marked steps where history is kept) and deletes
the rest.  All paths go through Hadoop's file system, so the store can lie wherever Spark
can write; the pointer is replaced by an overwriting rename, which readers see whole or not.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession

from edictum.operators import canon

STATE = "s string, p string, o struct<kind:string,lex:string,dt:string,native:boolean>"


class DuplicateStep(Exception):
    """A step of this id is committed already."""


class Crash(Exception):
    """Raised at an injected crash point."""


def step_id(input_digest: str, window_id: str) -> str:
    return hashlib.sha256(f"step|{input_digest}|{window_id}".encode()).hexdigest()[:32]


class StepStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._path(f"{self.root}/steps"))

    def _exists(self, path: str) -> bool:
        return self.fs.exists(self._path(path))

    def _read(self, path: str) -> str | None:
        found = self._path(path)
        if not self.fs.exists(found):
            return None
        stream = self.fs.open(found)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _put(self, path: str, text: str) -> None:
        """Written beside and renamed over, so readers see the old or the new text."""
        jvm = self.spark.sparkContext._jvm
        beside, target = self._path(path + ".tmp"), self._path(path)
        out = self.fs.create(beside, True)
        out.write(bytearray(text.encode()))
        out.hsync()
        out.close()
        kind = jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = next(x for x in kind.getEnumConstants() if x.toString() == "OVERWRITE")
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(self.fs.makeQualified(beside), self.fs.makeQualified(target), how)

    def pointer(self) -> dict | None:
        """step, digest, before and count of the current step."""
        text = self._read(f"{self.root}/CURRENT")
        return json.loads(text) if text else None

    def current(self) -> str | None:
        found = self.pointer()
        return found["step"] if found else None

    def has(self, name: str) -> bool:
        """Whether a step is committed: the pointer names it or has moved on from it."""
        return self.current() == name or self._exists(f"{self.root}/steps/{name}/PASSED")

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/kept/{name}"
        frame.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def kept(self, spark: SparkSession, names: str, schema: str) -> DataFrame:
        """All kept tables whose names match, as one; empty where there are none."""
        if not self.fs.globStatus(self._path(f"{self.root}/kept/{names}")):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{self.root}/kept/{names}")

    def commit_state(self, state: DataFrame, decisions: DataFrame, name: str, crash_at: str | None = None) -> DataFrame:
        """Writes a step and switches the pointer to it; returns its state as stored.

        Whatever a crash leaves before the switch is overwritten by the next attempt.
        """
        if self.has(name):
            raise DuplicateStep(name)
        folder = f"{self.root}/steps/{name}"

        def reached(point: str) -> None:
            if crash_at == point:
                raise Crash(point)

        decisions.write.mode("overwrite").parquet(f"{folder}/decisions")
        reached("after_trace")
        state.select("s", "p", "o").write.mode("overwrite").parquet(f"{folder}/state")
        reached("after_state")
        stored = self.state(name)
        digest = canon.digest(stored)
        self._put(f"{folder}/DIGEST", digest)
        reached("after_digest")
        before = self.pointer()
        if before:
            self._put(f"{self.root}/steps/{before['step']}/PASSED", before["digest"])
        reached("before_pointer")
        self._put(f"{self.root}/CURRENT", json.dumps({"step": name, "digest": digest, "before": before and before["step"], "count": before["count"] + 1 if before else 1}))
        reached("after_pointer")
        return stored

    def commit_window(self, input_digest: str, window_id: str, state: DataFrame, decisions: DataFrame, crash_at: str | None = None) -> str:
        """``commit_state`` under the step's own id; the same input and window are one step."""
        name = step_id(input_digest, window_id)
        self.commit_state(state, decisions, name, crash_at)
        return name

    def state(self, name: str) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(f"{self.root}/steps/{name}/state")

    def decisions(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/steps/{name}/decisions")

    def current_state(self, spark: SparkSession) -> DataFrame | None:
        name = self.current()
        return None if name is None else self.state(name)

    def verify(self) -> dict:
        """Whether the pointer, the step's digest and the stored state agree, and why not."""
        found = self.pointer()
        if found is None:
            return {"consistent": True, "reason": "empty store"}
        folder = f"{self.root}/steps/{found['step']}"
        if not self._exists(f"{folder}/state/_SUCCESS") or not self._exists(f"{folder}/decisions/_SUCCESS"):
            return {"consistent": False, "reason": "the pointer names missing tables", "step": found["step"]}
        agree = canon.digest(self.state(found["step"])) == found["digest"] == self._read(f"{folder}/DIGEST")
        return {"consistent": agree, "reason": "verified" if agree else "digest mismatch", "step": found["step"]}

    def recover(self, history: bool = False) -> dict:
        """Deletes every step but the one that the pointer names (and, with ``history``, those
        it has passed), then verifies that one."""
        gone = []
        for entry in self.fs.listStatus(self._path(f"{self.root}/steps")):
            name = entry.getPath().getName()
            if name != self.current() and not (history and self.has(name)):
                self.fs.delete(entry.getPath(), True)
                gone.append(name)
        return {"committed": self.current(), "discarded": sorted(gone), "verification": self.verify()}
