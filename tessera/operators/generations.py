"""Storage of vectors by generation of the model that made them: one generation is active, and vectors of two never mix.

The register of generations is a document of the shared folder, written whole with every change; the last one committed says
which generation is active, so a switch is one step for its readers, and a reader that pinned a state keeps it. The vectors
of a generation are a table of their own, partitioned by the batch that wrote them.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import valid_vector
from tessera.sources.commits import Commits
from tessera.sources.scratch import remove


@dataclass(frozen=True)
class Identity:
    """What makes vectors comparable; a difference in any of it is another generation."""

    provider: str
    model: str
    revision: str
    dimension: int
    pooling: str = "mean"
    normalization: str = "l2"


@dataclass(frozen=True)
class Generation:
    id: int
    identity: Identity
    status: str
    checksum: str | None = None
    activated: str | None = None
    retired: str | None = None
    batches: int = 0
    error: str | None = None


class Generations:
    """Generations in a folder; times are given by the caller. Needs one writer at a time: a change on top of one that came
    meanwhile fails, and changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.states = Commits(spark, f"{self.path}/states")

    def state(self) -> int:
        """Number of the current state of the register, for readers to pin."""
        return self.states.latest()

    def all(self, state: int | None = None) -> list[Generation]:
        """The generations that are stored, by id."""
        n = self.states.latest() if state is None else state
        if not n:
            return []
        return [Generation(**{**g, "identity": Identity(**g["identity"])}) for g in json.loads(self.states.read(n))["stored"]]

    def active(self, state: int | None = None) -> Generation | None:
        return next((g for g in self.all(state) if g.status == "active"), None)

    def get(self, id: int, state: int | None = None) -> Generation:
        found = next((g for g in self.all(state) if g.id == id), None)
        if found is None:
            raise KeyError(f"unknown generation {id}")
        return found

    def create(self, identity: Identity, checksum: str | None = None) -> Generation:
        """The generation of an identity; a new one is being built and not active, so that it can be filled first."""
        known = next((g for g in self.all() if g.identity == identity), None)
        if known:
            return known
        if identity.dimension < 1:
            raise ValueError("a vector has at least one dimension")
        last = self.states.latest()
        new = Generation((json.loads(self.states.read(last))["last"] if last else 0) + 1, identity, "building", checksum)
        self._commit([*self.all(), new], new.id)
        return new

    def activate(self, identity: Identity, at: datetime, checksum: str | None = None) -> Generation:
        """Makes the generation of an identity the only active one, in one step; the one before is retired. A retired generation comes
        back with what it stores, as long as it was not dropped."""
        own = self.create(identity, checksum)
        if own.status == "active":
            return own
        now = []
        for g in self.all():
            if g.id == own.id:
                own = replace(g, status="active", activated=g.activated or at.isoformat(), retired=None, checksum=checksum or g.checksum, error=None)
                now.append(own)
            else:
                now.append(replace(g, status="retired", retired=at.isoformat()) if g.status == "active" else g)
        self._commit(now)
        return own

    def roll_back(self, at: datetime, window: timedelta) -> Generation:
        """Makes the generation that was retired last active again, if that was at most `window` ago."""
        retired = [g for g in self.all() if g.status == "retired" and at - datetime.fromisoformat(g.retired) <= window]
        if not retired:
            raise LookupError("no generation was retired within the window")
        return self.activate(max(retired, key=lambda g: (g.retired, g.id)).identity, at)

    def drop(self, id: int, at: datetime, window: timedelta) -> None:
        """Forgets a retired generation and its vectors once its window to roll back has passed."""
        g = self.get(id)
        if g.status != "retired" or at - datetime.fromisoformat(g.retired) <= window:
            raise ValueError(f"generation {id} is {g.status} and cannot be dropped yet")
        self._commit([x for x in self.all() if x.id != id])
        remove(self.spark, f"{self.path}/vectors/generation={id}")

    def failed(self, id: int, message: str) -> None:
        """Records a generation's last error, cut at 2000 characters."""
        self.get(id)
        self._commit([replace(g, error=message[:2_000]) if g.id == id else g for g in self.all()])

    def store(self, id: int, vectors: DataFrame, documents: DataFrame | None = None) -> None:
        """Adds vectors (key, source_hash, embedding) to a generation. If any has not the generation's dimension, is not finite or has a
        null key, nothing is added. A key that comes again replaces what is there. documents: (key, source_hash) as they are now;
        vectors of a text that has changed meanwhile are left out, and stay missing()."""
        g = self.get(id)
        if documents is not None:
            vectors = vectors.join(documents.select("key", "source_hash"), ["key", "source_hash"], "left_semi")
        where = f"{self.path}/vectors/generation={id}/batch={g.batches + 1}"
        rows = vectors.select("key", "source_hash", F.col("embedding").cast("array<double>").alias("embedding"))
        rows.write.mode("overwrite").parquet(where)
        good = F.col("key").isNotNull() & valid_vector(F.col("embedding"), g.identity.dimension)
        bad = self.spark.read.schema(rows.schema).parquet(where).filter(~good).count()
        if bad:
            remove(self.spark, where)
            raise ValueError(f"{bad} vectors do not fit generation {id} of dimension {g.identity.dimension}")
        self._commit([replace(x, batches=x.batches + 1) if x.id == id else x for x in self.all()])

    def vectors(self, id: int | None = None, state: int | None = None) -> DataFrame | None:
        """(key, source_hash, embedding) of a generation, or of the active one, as of a state; null where nothing is stored. Repeated
        keys of one batch: the greatest source hash."""
        g = self.active(state) if id is None else self.get(id, state)
        if g is None or not g.batches:
            return None
        folder = f"{self.path}/vectors/generation={g.id}"
        rows = self.spark.read.option("basePath", folder).parquet(*(f"{folder}/batch={n}" for n in range(1, g.batches + 1)))
        last = rows.groupBy("key").agg(F.max_by(F.struct("source_hash", "embedding"), F.struct("batch", "source_hash")).alias("v"))
        return last.select("key", "v.*")

    def missing(self, documents: DataFrame, id: int | None = None) -> DataFrame:
        """Documents (key, source_hash) without a vector of their present text in a generation: what is left to embed."""
        held = self.vectors(id)
        return documents if held is None else documents.join(held.select("key", "source_hash"), ["key", "source_hash"], "left_anti")

    def _commit(self, stored: list[Generation], last: int | None = None) -> None:
        n = self.states.latest()
        if last is None:
            last = json.loads(self.states.read(n))["last"]
        self.states.commit(n + 1, json.dumps({"last": last, "stored": [asdict(g) for g in stored]}))
