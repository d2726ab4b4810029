"""What a run needs besides data: the profile a machine is fit for, versions to apply, a token that stops or holds a run."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def hardware_profile(df: DataFrame) -> DataFrame:
    """df (ram_gb, gpu, vram_gb, disk_gb) with profile, suitable and warnings; unknown sizes count as 0, an unknown gpu as none."""
    ram, vram, disk = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("ram_gb", "vram_gb", "disk_gb"))
    gpu = F.coalesce(F.col("gpu"), F.lit(False))
    strong, fair = gpu & (vram >= 10), gpu & (vram >= 5.5)
    profile = F.when(strong, "quality").when(fair | (ram >= 15), "balanced").otherwise("economy")
    told = F.array(
        F.when(disk < 5, "disk"), F.when(gpu & ~fair, "gpu memory"), F.when(~fair & (ram >= 7.5) & (ram < 15), "economy only"), F.when(~fair & (ram < 7.5), "memory"))
    return df.withColumns({"profile": profile, "suitable": fair | (ram >= 7.5), "warnings": F.array_compact(told)})


def pending_versions(known: DataFrame, applied: DataFrame) -> DataFrame:
    """Rows of known (version, name) that applied (version) lacks, in order; a null among the applied ones is no version."""
    return known.join(applied.where("version IS NOT NULL").select("version").distinct(), "version", "left_anti").orderBy("version")


class Cancelled(Exception):
    """A run was stopped by its token."""


class Token:
    """Stops a run at once, or holds it between its steps.

    cancel() also ends the Spark jobs that a step has started, by their tag; steps that were done stay done, and a later run
    with the same store of results takes up from there. pause() and resume() may be called from any thread.
    """

    def __init__(self, spark: SparkSession):
        self.context = spark.sparkContext
        self.tag = f"lexloom-{uuid.uuid4().hex}"
        self._go = threading.Event()
        self._go.set()
        self._stopped = False

    def cancel(self) -> None:
        self._stopped = True
        self._go.set()
        self.context.cancelJobsWithTag(self.tag)

    def pause(self) -> None:
        self._go.clear()

    def resume(self) -> None:
        self._go.set()

    def check(self) -> None:
        """Wait while the run is held; raise Cancelled if it was stopped."""
        self._go.wait()
        if self._stopped:
            raise Cancelled(self.tag)

    def run(self, steps: Iterable[Callable[[], object]]) -> Iterable[object]:
        """Results of the steps, each begun only if the token allows it; jobs of a step carry the tag."""
        for step in steps:
            self.check()
            self.context.addJobTag(self.tag)
            try:
                yield step()
            except Exception as e:
                if self._stopped:
                    raise Cancelled(self.tag) from e
                raise
            finally:
                self.context.removeJobTag(self.tag)
