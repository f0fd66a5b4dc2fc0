"""Versions of a workbook from upload to activation: one object over the stored cells, runs, models, validation, differences and snapshots.

A version is ``uploaded``, then ``pending_review`` (or ``failed`` where its formulas can't be interpreted), then ``active``; the one before becomes ``superseded``. The registry of versions is
a small JSON file for each version; cells, runs and snapshots are Parquet below one shared folder.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import values as V
from .operators import structure as T
from .operators import validation as Q
from .plans import diff as D
from .plans import run as R
from .plans.model import Model, derive
from .sources import store
from .sources.xlsx import read_workbook

#: Exports of more cells run as a job of their own.
LARGE_EXPORT = 250_000
SNAPSHOT = "key string, label string, category string, rank long, quartile int, score double"


class Refused(ValueError):
    """The step isn't allowed in the version's state."""


class Workspace:
    """All that a caller needs, by version ids. ``root``: a folder that the driver and all executors share."""

    def __init__(self, spark: SparkSession, root: str, config: dict | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or {}
        self.models: dict[str, Model] = {}

    # -- registry ---------------------------------------------------------------------------------------------------

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _put(self, version: dict) -> dict:
        fs, path = self._path(f"versions/{version['version']}.json")
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(version).encode()))
        out.close()
        return version

    def versions(self) -> list[dict]:
        """Oldest first; some dozens of small files."""
        fs, folder = self._path("versions")
        if not fs.exists(folder):
            return []
        rows = self.spark.read.text(f"{self.root}/versions", wholetext=True).collect()
        return sorted((json.loads(r["value"]) for r in rows), key=lambda v: (v["uploaded_at"], v["version"]))

    def version(self, name: str) -> dict:
        found = next((v for v in self.versions() if v["version"] == name), None)
        if not found:
            raise Refused(f"no version {name}")
        return found

    def current(self) -> str | None:
        """The active version, else the newest that has a baseline run."""
        rows = self.versions()
        active = [v for v in rows if v["status"] == "active"] or [v for v in rows if v.get("baseline")]
        return active[-1]["version"] if active else None

    def previous(self, name: str) -> str | None:
        """The version that was active before: the latest activated one that was uploaded earlier."""
        me = self.version(name)
        rows = [v for v in self.versions() if v["version"] != name and v.get("activated_at") and v["uploaded_at"] < me["uploaded_at"]]
        return max(rows, key=lambda v: v["activated_at"])["version"] if rows else None

    # -- upload to review -------------------------------------------------------------------------------------------

    def upload(self, source: str | DataFrame, names: dict[str, str] | None = None, title: str = "") -> str:
        """Stores a workbook file's (or a frame's) cells as a new version."""
        cells = read_workbook(self.spark, source) if isinstance(source, str) else source
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex[:6]}"
        store.save_cells(cells, self.root, name)
        self._put({"version": name, "title": title, "uploaded_at": time.time_ns(), "status": "uploaded", "names": names or {}, "baseline": None, "activated_at": None, "validation": None, "note": None})
        return name

    def cells(self, name: str) -> DataFrame:
        return store.load_cells(self.spark, self.root, name)

    def model(self, name: str) -> Model:
        if name not in self.models:
            self.models[name] = derive(self.cells(name), self.version(name)["names"])
        return self.models[name]

    def process(self, name: str) -> dict:
        """Interprets, runs, validates and compares a version with the active one. Never raises: what fails is in the report and in the version's state."""
        report, active, now = {"version": name, "steps": {}}, self.current(), self.version(name)

        def step(what, f):
            try:
                report["steps"][what] = f()
                return True
            except Exception as e:  # the report is the place for it
                report["steps"][what], report["failed"] = {"error": str(e)[:500]}, what
                return False

        ok = step("interpret", lambda: self.model(name).summary()) and step("run", lambda: {"run": self.baseline(name)}) and step("validate", lambda: self.validate(name))
        if ok and active and active != name:
            step("compare", lambda: {"headline": self.compare(active, name)["headline"]})
        now = self.version(name)
        self._put(now | {"status": "pending_review" if ok else "failed", "note": report.get("failed")})
        report["status"] = "pending_review" if ok else "failed"
        return report

    def baseline(self, name: str) -> str:
        """The full run of a version; made once."""
        now = self.version(name)
        if now["baseline"]:
            return now["baseline"]
        run = f"{name}-base"
        store.save_run(R.run(self.cells(name), self.model(name), skip_unsupported=True), self.root, run)
        self._put(now | {"baseline": run})
        return run

    def values(self, name: str, *runs: str) -> DataFrame:
        """Computed cells of the baseline and further runs over it, the latest value of each."""
        return store.load_run(self.spark, self.root, [self.baseline(name), *runs])

    def what_if(self, name: str, overrides: dict, parents: tuple = ()) -> str:
        """A run of what the overrides reach, stored over its parents."""
        run = f"{name}-{uuid.uuid4().hex[:8]}"
        store.save_run(R.run(self.cells(name), self.model(name), overrides, self.values(name, *parents)), self.root, run, parents[-1] if parents else self.baseline(name))
        return run

    def validate(self, name: str) -> dict:
        """Reconciles the baseline with the stored values; counts, status and coverage by sheet."""
        cells = self.cells(name).where("formula is not null")
        skipped = {b.key for b in self.model(name).blocks if R.L.called(b.tree) & self.model(name).unsupported()}
        counts, _ = Q.reconcile(self.values(name), cells)
        rows = [(r["sheet"], r["class"], r["n"]) for r in counts.collect()]  # a row per sheet and class
        total: dict[str, int] = {}
        for _, kind, n in rows:
            total[kind] = total.get(kind, 0) + n
        found = {"status": Q.status(total), "counts": total, "skipped_templates": len(skipped), "sheets": {s: {k: n for t, k, n in rows if t == s} for s in {r[0] for r in rows}}}
        self._put(self.version(name) | {"validation": found})
        return found

    def compare(self, old: str, new: str) -> dict:
        return D.compare(self.cells(old), self.cells(new), self.model(old), self.model(new))

    def activate(self, name: str, reason: str | None = None) -> dict:
        """Makes a version the active one. It needs a validation; a failed one needs a reason; formulas that go round in a circle can't be activated at all."""
        now = self.version(name)
        if self.model(name).cycles:
            raise Refused("formulas go round in a circle")
        if not now["validation"]:
            raise Refused("not validated yet")
        if now["validation"]["status"] == "failed" and not (reason or "").strip():
            raise Refused("validation failed: a reason is needed")
        for v in self.versions():
            if v["status"] == "active" and v["version"] != name:
                self._put(v | {"status": "superseded"})
        return self._put(now | {"status": "active", "activated_at": time.time_ns(), "note": reason})

    # -- what is read ------------------------------------------------------------------------------------------------

    def lineage(self, name: str, target: str, depth: int = 1) -> dict:
        return R.lineage(self.values(name), self.cells(name), self.model(name), target, depth=depth)

    def rules(self, name: str, sheet: str | None = None, kind: str | None = None) -> list[dict]:
        """Business rules, of one sheet and kind if asked."""
        from .plans.model import rules as said

        return [{"sheet": b.rect.sheet, "area": b.rect.a1(), "kind": k, "words": words} for b in self.model(name).blocks for k, words in said(b) if (sheet is None or b.rect.sheet == sheet) and (kind is None or k == kind)]

    def graph(self, name: str) -> DataFrame:
        """Blocks with their depth, the longest path from an input."""
        m = self.model(name)
        blocks = self.spark.createDataFrame([(b.id, b.rect.sheet, b.rect.a1(), b.kind) for b in m.blocks], "node long, sheet string, area string, kind string")
        if not m.edges:
            return blocks.withColumn("depth", F.lit(0))
        return blocks.join(T.depths(self.spark.createDataFrame([(int(a), int(b)) for a, b in m.edges], "source long, target long")), "node", "left").fillna(0, ["depth"])

    # -- snapshots ----------------------------------------------------------------------------------------------------

    def save_snapshot(self, name: str, entities: DataFrame, as_of: float | None = None) -> None:
        """One version's ranks; taken again where its baseline changes. What-if runs don't come here: their snapshot is a frame in memory."""
        rows = entities.select("key", "label", "category", F.col("rank").cast("long").alias("rank"), F.col("quartile").cast("int").alias("quartile"), F.col("score").cast("double").alias("score"))
        marked = rows.withColumn("run", F.lit(self.baseline(name))).withColumn("as_of", F.lit(as_of).cast("double"))
        marked.write.mode("overwrite").parquet(f"{self.root}/snapshots/version={name}")

    def snapshot(self, name: str) -> DataFrame | None:
        """The stored snapshot, or None where there is none of the version's present baseline."""
        fs, path = self._path(f"snapshots/version={name}")
        if not fs.exists(path):
            return None
        rows = self.spark.read.schema(f"{SNAPSHOT}, run string, as_of double").parquet(f"{self.root}/snapshots/version={name}")
        return rows.drop("run") if rows.where(F.col("run") != self.baseline(name)).isEmpty() else None

    # -- exports ---------------------------------------------------------------------------------------------------------

    def export(self, frame: DataFrame, title: str) -> dict:
        """A frame as CSV below ``exports``, with its provenance. Large ones are written as many files, by a job of their own; small ones as one."""
        rows, run = frame.count(), uuid.uuid4().hex[:8]
        large = rows * len(frame.columns) > self.config.get("large_export", LARGE_EXPORT)
        path = f"{self.root}/exports/{run}"
        (frame if large else frame.coalesce(1)).write.option("header", True).csv(path)
        return {"title": title, "path": path, "rows": rows, "job": large, "version": self.current(), "made_at": time.time()}


def cells_schema() -> str:
    return f"sheet string, row int, col int, formula string, c {V.CELL}, format string"
