"""Stored models: a folder for each, and a catalogue that is published by one rename, so that a run that breaks off goes on there."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import SparkSession

from agrolith.operators.boosting import Booster
from agrolith.sources import files


class ModelStore:
    """Models below ``root``, a folder that driver and executors share.

    A model is known by its key (say ``boosted/huber``) and by the fingerprint of the features that it learned from, never by a
    time: after a partial run some models are new and some old, and both are there. Models are staged and renamed into
    place; then a new version of the catalogue is, which names them all. A reader takes the newest version, and
    one that read before finds its models still there until ``sweep``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _versions(self) -> list[int]:
        return sorted(int(m[1]) for n in files.children(self.spark, f"{self.root}/catalogue") if (m := re.fullmatch(r"v(\d+)", n)))

    def catalogue(self) -> dict[str, dict]:
        """Entries by key, of the newest version; a row a model, so short."""
        versions = self._versions()
        if not versions:
            return {}
        lines = self.spark.read.text(f"{self.root}/catalogue/v{versions[-1]}").collect()
        return {e["key"]: e for e in map(json.loads, (r.value for r in lines))}

    def _publish(self, entries: Mapping[str, dict]) -> None:
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        lines = [(json.dumps(entries[k], sort_keys=True),) for k in sorted(entries)]
        self.spark.createDataFrame(lines, "value string").coalesce(1).write.text(staged)
        number = (self._versions() or [0])[-1] + 1
        while not files.publish(self.spark, staged, f"{self.root}/catalogue/v{number}"):
            raise RuntimeError(f"another run has published version {number} of the catalogue; run again")

    def has(self, key: str, fingerprint: str) -> bool:
        e = self.catalogue().get(key)
        return e is not None and e["fingerprint"] == fingerprint and files.exists(self.spark, e["path"])

    def save(self, key: str, fingerprint: str, model, **facts) -> None:
        """Store a Booster or a fitted Spark ML model, then name it in the catalogue with ``facts`` (scores, is_default, ...)."""
        path = f"{self.root}/models/{re.sub(r'[^A-Za-z0-9]+', '_', key)}-{fingerprint}-{uuid.uuid4().hex[:8]}"
        staged = f"{self.root}/_staged/{uuid.uuid4().hex}"
        if isinstance(model, Booster):
            self.spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(staged)
        else:
            model.write().save(staged)
        files.publish(self.spark, staged, path)
        kind = "booster" if isinstance(model, Booster) else f"{type(model).__module__}.{type(model).__name__}"
        self._publish(self.catalogue() | {key: {"key": key, "fingerprint": fingerprint, "path": path, "kind": kind} | facts})

    def load(self, key: str):
        entry = self.catalogue()[key]
        if entry["kind"] == "booster":
            return Booster.from_json(self.spark.read.text(entry["path"]).first().value)
        module, name = entry["kind"].rsplit(".", 1)
        return getattr(__import__(module, fromlist=[name]), name).load(entry["path"])

    def train(self, wanted: Iterable[tuple[str, Callable[[], tuple]]], fingerprint: str) -> dict[str, str]:
        """Train what is absent: for each (key, train), where train returns (model, facts), say whether it was ``kept`` or ``trained``.

        Put defaults first: each model is there as soon as it is trained, so that a run that breaks off leaves them usable.
        """
        done = {}
        for key, train in wanted:
            if self.has(key, fingerprint):
                done[key] = "kept"
                continue
            model, facts = train()
            self.save(key, fingerprint, model, **facts)
            done[key] = "trained"
        return done

    def sweep(self) -> None:
        """Remove what no entry of the newest catalogue names, and older versions; call it when no other run is under way."""
        named = {e["path"].rsplit("/", 1)[1] for e in self.catalogue().values()}
        for n in files.children(self.spark, f"{self.root}/models"):
            if n not in named:
                files.remove(self.spark, f"{self.root}/models/{n}")
        for v in self._versions()[:-1]:
            files.remove(self.spark, f"{self.root}/catalogue/v{v}")
        files.remove(self.spark, f"{self.root}/_staged")
