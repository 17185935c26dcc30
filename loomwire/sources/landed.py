"""Landed payloads of many sources as one stream: a Spark data source with offsets and admission.

Each active source has a folder where its payloads land, one file a fetch, with names that rise over time. The offset is
the last file taken of each source, so a restart goes on where the checkpoint is, and a source that is added later starts
at its beginning. While too much waits in the queue the latest offset stays where it is, and the pass is skipped. A file
that can't be read is a row with its error; it stops neither its source nor another.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "source string, type string, file string, payload string, error string"


def _files(path: str):  # noqa: ANN202
    """The file system that a path names, and the path on it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _text(path: str) -> str | None:
    system, at = _files(path)
    try:
        with system.open_input_stream(at) as f:
            return f.read().decode()
    except FileNotFoundError:
        return None


def _write(path: str, text: str) -> None:
    system, at = _files(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    with system.open_output_stream(at) as f:
        f.write(text.encode())


def write_depth(root: str, waiting: int) -> None:
    """What `latestOffset` reads before it admits more."""
    _write(f"{root.rstrip('/')}/depth", str(waiting))


@dataclass
class Payload(InputPartition):
    source: str
    type: str
    path: str


class Landed(DataSource):
    """Options: `sources`, JSON of [{name, type, path, active}]; `root`, a folder for position and depth; `most` (2000), the
    depth above which nothing is admitted; `files` (1000), how many files one micro-batch takes at most."""

    @classmethod
    def name(cls) -> str:
        return "landed"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: object) -> Reader:
        return Reader(dict(self.options))


class Reader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.sources = [s for s in json.loads(options["sources"]) if s.get("active", True)]
        self.root, self.most, self.files = options["root"].rstrip("/"), int(options.get("most", 2000)), int(options.get("files", 1000))

    def _position(self) -> dict:
        """The end of the last micro-batch that was planned. Spark logs an end before it plans, so it is never behind."""
        return json.loads(_text(f"{self.root}/position") or "{}")

    def initialOffset(self) -> dict:
        return {}

    def _after(self, source: dict, last: str) -> list[str]:
        from pyarrow import fs

        system, at = _files(source["path"])
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.base_name for f in found if f.is_file and f.base_name > last and not f.base_name.startswith((".", "_")))

    def latestOffset(self) -> dict:
        position = self._position()
        if int(_text(f"{self.root}/depth") or 0) > self.most:
            return position
        new = {s["name"]: self._after(s, position.get(s["name"], "")) for s in self.sources}
        out, left = dict(position), self.files
        # by turns, so that a source with many files doesn't keep the others waiting
        turn = 0
        while left and any(len(x) > turn for x in new.values()):
            for name, files in new.items():
                if left and len(files) > turn:
                    out[name], left = files[turn], left - 1
            turn += 1
        return out

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        _write(f"{self.root}/position", json.dumps(end))
        out = []
        for s in self.sources:
            if end.get(s["name"], "") > start.get(s["name"], ""):
                out += [Payload(s["name"], s["type"], f"{s['path'].rstrip('/')}/{f}") for f in self._after(s, start.get(s["name"], "")) if f <= end[s["name"]]]
        return out

    def read(self, partition: Payload) -> Iterator[tuple]:
        name = partition.path.rpartition("/")[2]
        try:
            yield partition.source, partition.type, name, _text(partition.path), None
        except Exception as problem:  # noqa: BLE001  one source's trouble is a row, whatever it is
            yield partition.source, partition.type, name, None, f"{type(problem).__name__}: {problem}"
