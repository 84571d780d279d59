"""A streaming source of manifests one folder deep, told by path and fingerprint.

An offset names a snapshot of the library: which manifests there are and each one's
fingerprint (time of change in nanoseconds and size). Snapshots lie in the
``state`` folder under their own digest, so an offset in a checkpoint stays
small and a restarted query knows what it has seen. A batch has a row for each
manifest that is new, changed or gone between its two snapshots; a move gives both paths.

A manifest that changes after its snapshot is read as it then is, and comes again in the next batch.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pa_fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from subtide.sources.storage import exists, located

SCHEMA = "path string, change string, fingerprint string, value string"
#: Manifests read by one task.
BUNDLE = 200


def fingerprint(info: pa_fs.FileInfo) -> str:
    """Time of change in nanoseconds and size."""
    return f"{info.mtime_ns}:{info.size}"


def snapshot(library: str, name: str) -> dict[str, str]:
    """Relative path -> fingerprint of the files ``<folder>/<name>`` under ``library``."""
    fs, root = located(library)
    folders = [i for i in fs.get_file_info(pa_fs.FileSelector(root, allow_not_found=True)) if i.type == pa_fs.FileType.Directory]
    found = fs.get_file_info([f"{i.path}/{name}" for i in folders]) if folders else []
    return {f"{i.path.rsplit('/', 2)[-2]}/{name}": fingerprint(i) for i in found if i.type == pa_fs.FileType.File}


@dataclass
class Bundle(InputPartition):
    """(path, change, fingerprint) of some manifests."""

    rows: list[tuple[str, str, str | None]]


class ManifestReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.library, self.state = options["path"].rstrip("/"), options["state"].rstrip("/")
        self.name = options.get("manifest", ".media.json")

    def initialOffset(self) -> dict:
        return {"snapshot": ""}

    def latestOffset(self) -> dict:
        seen = json.dumps(snapshot(self.library, self.name), sort_keys=True, ensure_ascii=False).encode()
        digest = hashlib.sha256(seen).hexdigest()
        fs, folder = located(self.state)
        path = f"{folder}/{digest}.json"
        if not exists(fs, path):
            fs.create_dir(folder, recursive=True)
            draft = f"{folder}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(draft, compression=None) as out:
                out.write(seen)
            fs.move(draft, path)
        return {"snapshot": digest}

    def _known(self, offset: dict) -> dict[str, str]:
        if not offset["snapshot"]:
            return {}
        fs, folder = located(self.state)
        with fs.open_input_stream(f"{folder}/{offset['snapshot']}.json", compression=None) as f:
            return json.loads(f.read())

    def partitions(self, start: dict, end: dict) -> list[Bundle]:
        before, after = self._known(start), self._known(end)
        rows = [(p, "removed", None) for p in sorted(before.keys() - after.keys())]
        rows += [(p, "changed" if p in before else "added", f) for p, f in sorted(after.items()) if before.get(p) != f]
        return [Bundle(rows[k : k + BUNDLE]) for k in range(0, len(rows), BUNDLE)]

    def read(self, partition: Bundle) -> Iterator[pa.RecordBatch]:
        texts = []
        for path, change, _ in partition.rows:
            fs, full = located(f"{self.library}/{path}")
            text = None
            if change != "removed" and exists(fs, full):  # gone since: the next batch says so
                with fs.open_input_stream(full, compression=None) as f:
                    text = f.read().decode("utf-8", "replace")
            texts.append(text)
        paths, changes, prints = zip(*partition.rows, strict=True)
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(changes, pa.string()), pa.array(prints, pa.string()), pa.array(texts, pa.string())],
            names=["path", "change", "fingerprint", "value"],
        )

    def commit(self, end: dict) -> None:
        """Snapshots before the one that is done are needed no more."""
        fs, folder = located(self.state)
        done = f"{end['snapshot']}.json"
        infos = {i.base_name: i for i in fs.get_file_info(pa_fs.FileSelector(folder, allow_not_found=True))}
        if done in infos:
            for i in infos.values():
                if i.base_name != done and i.base_name.endswith(".json") and i.mtime_ns < infos[done].mtime_ns:
                    fs.delete_file(i.path)


class Manifests(DataSource):
    """``spark.readStream.format("manifests").option("state", folder).load(library)``, once registered by ``spark.dataSource.register(Manifests)``."""

    @classmethod
    def name(cls) -> str:
        return "manifests"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> ManifestReader:
        return ManifestReader(self.options)
