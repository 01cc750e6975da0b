"""Repository facts as a data source: format("repository") with options path and kind, as a table or as a stream.

Kinds: inventory (files with language, size and hash), log (paths of commits), clones (reports of a clone detector) and
projects (references of projects, and members of solutions in both of their formats). Files are listed on the driver and
dealt out in partitions of about partition_bytes, many small files to a task; filters on the file's name, or on an inventory's
language, choose among them before anything is opened. The stream brings files in order of (time, name), whole files only.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith

from .readers import LANGUAGES

SCHEMAS = {
    "inventory": "file string, language string, bytes long, hash string",
    "log": "file string, commit_id string, path string",
    "clones": "file string, clone_id string, first_path string, first_start int, first_end int, second_path string, second_start int, second_end int, tokens int, lines int",
    "projects": "file string, kind string, reference string",
}
ENDINGS = {"inventory": ("",), "log": ("",), "clones": (".json",), "projects": (".csproj", ".sln", ".slnx")}
PARTITION_BYTES = 64 << 20


@dataclass
class Files(InputPartition):
    names: list[tuple[str, int]]  # (name under the root, bytes)


def language_of(name: str) -> str:
    return LANGUAGES.get(name.rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower() if "." in name.rsplit("/", 1)[-1] else "", "other")


def _read_inventory(name: str, lines: Iterator[bytes], size: int) -> Iterator[tuple]:
    digest = hashlib.sha256()
    for part in lines:
        digest.update(part)
    yield name, language_of(name), size, digest.hexdigest().upper()


def _read_log(name: str, lines: Iterator[bytes], size: int) -> Iterator[tuple]:
    """A commit's paths, each once; headers and indented messages are passed over."""
    commit, seen = None, set()
    for raw in lines:
        line = raw.decode("utf-8", "replace").rstrip("\r\n")
        if m := re.match(r"commit ([0-9a-f]+)", line):
            commit, seen = m[1], set()
        elif commit and line and not re.match(r"(Author|Date|Merge): |\s", line) and line not in seen:
            seen.add(line)
            yield name, commit, line


def _read_clones(name: str, lines: Iterator[bytes], size: int) -> Iterator[tuple]:
    for d in json.loads(b"".join(lines))["duplicates"]:
        a, b = sorted((s["name"], int(s["start"]), int(s["end"])) for s in (d["firstFile"], d["secondFile"]))
        yield name, hashlib.sha256(repr((a, b)).encode()).hexdigest(), *a, *b, int(d["tokens"]), int(d["lines"])


def _read_projects(name: str, lines: Iterator[bytes], size: int) -> Iterator[tuple]:
    text = b"".join(lines).decode("utf-8-sig", "replace")
    if name.endswith(".sln"):
        found = re.findall(r'^Project\("\{[^"]*\}"\)\s*=\s*"[^"]*",\s*"([^"]+)"', text, re.M)
    else:
        wanted, attribute = ("ProjectReference", "Include") if name.endswith(".csproj") else ("Project", "Path")
        found = [e.get(attribute) for e in ElementTree.fromstring(text).iter() if e.tag.rsplit("}", 1)[-1] == wanted]
    for reference in found:
        if reference:
            yield name, name.rsplit(".", 1)[-1], reference.replace("\\", "/")


READERS = {"inventory": _read_inventory, "log": _read_log, "clones": _read_clones, "projects": _read_projects}


class _Reading:
    def __init__(self, options: dict):
        self.root, self.kind, self.most = options["path"].rstrip("/"), options.get("kind", "inventory"), int(options.get("partition_bytes", PARTITION_BYTES))
        if self.kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        self.tests: list[tuple[str, str, object]] = []  # (column, way, value)

    def _store(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root) if "://" in self.root else (fs.LocalFileSystem(), self.root.removeprefix("file:"))

    def listed(self) -> list[tuple[str, int, int]]:
        """(name, bytes, time in ns) of the files of this kind, by name, that the filters leave; what git keeps for itself is no source."""
        from pyarrow import fs

        store, top = self._store()
        out = []
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            name = info.path[len(top) :].lstrip("/")
            if info.type == fs.FileType.File and name.endswith(ENDINGS[self.kind]) and ".git" not in name.split("/") and self.wanted(name):
                out.append((name, info.size, info.mtime_ns))
        return sorted(out)

    def wanted(self, name: str) -> bool:
        ways = {"=": lambda v, x: v == x, "in": lambda v, x: v in x, "starts": str.startswith, "ends": str.endswith, "has": lambda v, x: x in v}
        return all(ways[way](name if column == "file" else language_of(name), value) for column, way, value in self.tests)

    def dealt(self, files: list[tuple[str, int, int]]) -> list[Files]:
        out, held = [], 0
        for name, size, _ in files:
            if not out or held + size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].names.append((name, size))
            held += size
        return out

    def rows(self, part: Files) -> Iterator[tuple]:
        store, top = self._store()
        for name, size in part.names:
            with store.open_input_stream(f"{top}/{name}") as f:
                yield from READERS[self.kind](name, self._lines(f), size)

    @staticmethod
    def _lines(f) -> Iterator[bytes]:
        rest = b""
        while block := f.read(1 << 20):
            lines = (rest + block).splitlines(keepends=True)
            # the last line may go on in the next block, and a carriage return may be half of a line's end
            rest = lines.pop() if lines else b""
            yield from lines
        if rest:
            yield rest


class RepositoryReader(_Reading, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        ways = {EqualTo: "=", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "has"}
        columns = {"file", "language"} if self.kind == "inventory" else {"file"}
        for f in filters:
            way = ways.get(type(f))
            if way and len(f.attribute) == 1 and f.attribute[0] in columns:
                self.tests.append((f.attribute[0], way, f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        return self.dealt(self.listed())

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition) if partition else iter(())


class RepositoryStream(_Reading, DataSourceStreamReader):
    """Offsets are (time, name) of the last file of a batch."""

    def initialOffset(self) -> dict:
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:
        last = max(((t, n) for n, _, t in self.listed()), default=(0, ""))
        return {"time": last[0], "name": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        a, b = (start["time"], start["name"]), (end["time"], end["name"])
        return self.dealt([f for f in self.listed() if a < (f[2], f[0]) <= b])

    def read(self, partition: Files) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        pass


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        kind = self.options.get("kind", "inventory")
        if kind not in SCHEMAS:
            raise ValueError(f"kind is one of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema) -> RepositoryReader:
        return RepositoryReader(dict(self.options))

    def streamReader(self, schema) -> RepositoryStream:
        return RepositoryStream(dict(self.options))
