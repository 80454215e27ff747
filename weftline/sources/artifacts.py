"""Published artifacts: data first, a manifest last; reads go through the manifest and check what they read."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.session import list_names, read_text, write_text_atomic


class ArtifactStore:
    """Named tables in a folder. A version of the folder is one manifest; older versions stay readable until removed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> dict:
        names = [n for n in list_names(self.spark, self.path) if n.startswith("manifest-") and n.endswith(".json")]
        return json.loads(read_text(self.spark, f"{self.path}/{names[-1]}")) if names else {"version": 0, "artifacts": {}}

    def publish(self, tables: dict[str, tuple[DataFrame, str]]) -> int:
        """Write tables (frame, schema version) aside and name them all by one new manifest. Gives its version."""
        old = self.manifest()
        entries = dict(old["artifacts"])
        for name, (df, version) in tables.items():
            folder = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.path}/{folder}")
            back = self.spark.read.parquet(f"{self.path}/{folder}")
            entries[name] = {"folder": folder, "schema_version": version, "schema": back.schema.json(), "digest": self._digest(folder)}
        number = old["version"] + 1
        write_text_atomic(self.spark, f"{self.path}/manifest-{number:012d}.json", json.dumps({"version": number, "artifacts": entries}))
        return number

    def _digest(self, folder: str) -> str:
        """sha-256 over the names and sha-256 digests of a table's files, hashed where they lie."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{self.path}/{folder}")
        one = files.select(F.concat_ws(":", F.substring_index("path", "/", -1), F.sha2("content", 256)).alias("f"))
        # one short text for each file of a table, as many as tasks wrote it
        return one.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("f")), "\n"), 256)).first()[0]

    def trusted(self, names: Collection[str], fingerprint: str, versions: Collection[str]) -> tuple[str, str]:
        """(status, reason): whether what is published may be built upon; the first check that fails decides.

        The chain is cache record -> manifest -> tables: the cache record (seal()) holds the manifest's sha-256 and the
        fingerprint of the configuration, the manifest the digest of each table. unavailable: something is not there;
        incompatible: it is of another version or configuration; unsafe: it is not what was recorded.
        """
        records = [n for n in list_names(self.spark, self.path) if n.startswith("cache-") and n.endswith(".json")]
        if not records:
            return "unavailable", "cache-missing"
        try:
            cache = json.loads(read_text(self.spark, f"{self.path}/{records[-1]}"))
        except ValueError:
            return "incompatible", "cache-invalid"
        if cache.get("fingerprint") != fingerprint:
            return "incompatible", "config-mismatch"
        name = cache.get("manifest", "")
        if not re.fullmatch(r"manifest-\d+\.json", name):
            return "unsafe", "artifact-path-escape"
        if name not in list_names(self.spark, self.path):
            return "unavailable", "manifest-missing"
        text = read_text(self.spark, f"{self.path}/{name}")
        if hashlib.sha256(text.encode()).hexdigest() != cache.get("sha256"):
            return "unsafe", "manifest-hash-mismatch"
        artifacts = json.loads(text)["artifacts"]
        for n in names:
            entry = artifacts.get(n)
            if entry is None:
                return "unavailable", f"{n}-missing"
            if "/" in entry["folder"] or ".." in entry["folder"]:
                return "unsafe", "artifact-path-escape"
            if entry["schema_version"] not in versions:
                return "incompatible", f"{n}-incompatible"
            if not list_names(self.spark, f"{self.path}/{entry['folder']}"):
                return "unavailable", f"{n}-missing"
            if self._digest(entry["folder"]) != entry["digest"]:
                return "unsafe", f"{n}-hash-mismatch"
        return "trusted", ""

    def seal(self, fingerprint: str) -> None:
        """Record the newest manifest, by its sha-256, as the one to build upon."""
        name = f"manifest-{self.manifest()['version']:012d}.json"
        text = read_text(self.spark, f"{self.path}/{name}")
        number = len([n for n in list_names(self.spark, self.path) if n.startswith("cache-")])
        body = json.dumps({"manifest": name, "sha256": hashlib.sha256(text.encode()).hexdigest(), "fingerprint": fingerprint})
        write_text_atomic(self.spark, f"{self.path}/cache-{number:012d}.json", body)

    def export_json(self, name: str, order: list[str]) -> str:
        """A table as one folder of JSON lines in a stable order; gives the folder."""
        folder = f"{self.path}/{name}-json-{uuid.uuid4().hex}"
        self.read(name).orderBy(*order).write.option("ignoreNullFields", "false").json(folder)
        return folder

    def read(self, name: str, versions: Collection[str] | None = None, verify: bool = False) -> DataFrame:
        """A table by its name. Refuses schema versions that are not listed; with verify also files that differ from what was written."""
        entry = self.manifest()["artifacts"].get(name)
        if entry is None:
            raise KeyError(name)
        if versions is not None and entry["schema_version"] not in versions:
            raise ValueError(f"{name}: schema version {entry['schema_version']}")
        from pyspark.sql.types import StructType

        df = self.spark.read.schema(StructType.fromJson(json.loads(entry["schema"]))).parquet(f"{self.path}/{entry['folder']}")
        if verify and self._digest(entry["folder"]) != entry["digest"]:
            raise ValueError(f"{name}: the rows are not those that were published")
        return df
