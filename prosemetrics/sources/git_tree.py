"""What a git repository has staged: its index and its commits as tables, and their texts.

``git_entries`` is a data source of paths and object ids; the index is one partition, a
commit one partition for each entry of its root. The repository is read where tasks run, so it lies in a folder
that all of them see. Object names are SHA-1; an index split over two files is refused.
"""

from __future__ import annotations

import bisect
import mmap
import os
import struct
import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ENTRY = "path string, mode int, oid string"
# Kinds of files by the upper bits of the mode, and of packed objects.
FOLDER, FILE, LINK = 0o04, 0o10, 0o12
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
OFFSET_DELTA, NAME_DELTA = 6, 7


class Repository:
    """Objects and names of a repository, read without git."""

    def __init__(self, root: str):
        at = os.path.join(root, ".git")
        if os.path.isfile(at):  # a worktree: the file says where its folder is
            with open(at) as f:
                at = os.path.join(root, f.read().split("gitdir:", 1)[1].strip())
        self.own = at if os.path.isdir(at) else root
        common = os.path.join(self.own, "commondir")
        self.common = os.path.join(self.own, self._line(common)) if os.path.exists(common) else self.own
        if not os.path.isdir(os.path.join(self.common, "objects")):
            raise ValueError(f"{root!r} is no git repository")
        if "objectformat = sha256" in self._text(os.path.join(self.common, "config")).lower():
            raise ValueError("object names of SHA-256 are not read")
        self.stores, waiting = [], [os.path.join(self.common, "objects")]
        while waiting:
            store = waiting.pop()
            if store not in self.stores:
                self.stores.append(store)
                more = self._text(os.path.join(store, "info", "alternates")).splitlines()
                waiting += [os.path.join(store, x) for x in more if x and not x.startswith("#")]
        self._packs: list[tuple[mmap.mmap, mmap.mmap]] | None = None

    @staticmethod
    def _text(path: str) -> str:
        try:
            with open(path, encoding="utf-8", errors="surrogateescape") as f:
                return f.read()
        except FileNotFoundError:
            return ""

    def _line(self, path: str) -> str:
        return self._text(path).strip()

    def commit_of(self, name: str = "HEAD") -> str | None:
        """The commit that a name stands for; null where the branch has none yet."""
        if len(name) == 40 and not set(name) - set("0123456789abcdef"):
            return name
        packed = dict(reversed(x.split(" ", 1)) for x in self._text(os.path.join(self.common, "packed-refs")).splitlines() if x and x[0] not in "#^")
        for ref in (name, f"refs/{name}", f"refs/tags/{name}", f"refs/heads/{name}"):
            said = self._line(os.path.join(self.own, ref)) if os.path.isfile(os.path.join(self.own, ref)) else ""
            said = said or (self._line(os.path.join(self.common, ref)) if os.path.isfile(os.path.join(self.common, ref)) else "") or packed.get(ref, "")
            if said.startswith("ref:"):
                return self.commit_of(said[4:].strip())
            if said:
                return said
        if name == "HEAD" or name.startswith("refs/heads/"):
            return None
        raise ValueError(f"no commit {name!r}")

    def read(self, oid: str) -> tuple[str, bytes]:
        """Kind and content of an object."""
        for store in self.stores:
            try:
                with open(os.path.join(store, oid[:2], oid[2:]), "rb") as f:
                    head, content = zlib.decompress(f.read()).split(b"\0", 1)
                return head.split(b" ")[0].decode(), content
            except FileNotFoundError:
                continue
        for index, pack in self.packs():
            at = self._offset(index, bytes.fromhex(oid))
            if at is not None:
                return self._packed(pack, at)
        raise KeyError(oid)

    def packs(self) -> list[tuple[mmap.mmap, mmap.mmap]]:
        if self._packs is None:
            self._packs = []
            for store in self.stores:
                folder = os.path.join(store, "pack")
                for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
                    if name.endswith(".idx"):
                        self._packs.append((self._mapped(os.path.join(folder, name)), self._mapped(os.path.join(folder, name[:-4] + ".pack"))))
        return self._packs

    @staticmethod
    def _mapped(path: str) -> mmap.mmap:
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)

    @staticmethod
    def _offset(index: mmap.mmap, name: bytes) -> int | None:
        """Where a pack holds an object, by its index (version 2): counts by first byte, names, checksums, offsets."""
        if index[:8] != b"\xfftOc\0\0\0\2":
            raise ValueError("a pack index of version 1 is not read")
        count = lambda b: struct.unpack_from(">I", index, 8 + 4 * b)[0]
        total, low, high = count(255), count(name[0] - 1) if name[0] else 0, count(name[0])
        names = 8 + 1024
        at = bisect.bisect_left(range(total), name, low, high, key=lambda i: index[names + 20 * i : names + 20 * i + 20])
        if at == high or index[names + 20 * at : names + 20 * at + 20] != name:
            return None
        offsets = names + 24 * total
        value = struct.unpack_from(">I", index, offsets + 4 * at)[0]
        return value if value < 1 << 31 else struct.unpack_from(">Q", index, offsets + 4 * total + 8 * (value - (1 << 31)))[0]

    def _packed(self, pack: mmap.mmap, at: int) -> tuple[str, bytes]:
        """An object of a pack: its chain of differences is followed to a whole object, then applied."""
        changes: list[bytes] = []
        while True:
            start, byte = at, pack[at]
            kind, at = byte >> 4 & 7, at + 1
            while byte & 0x80:
                byte, at = pack[at], at + 1
            if kind == OFFSET_DELTA:
                byte, at = pack[at], at + 1
                back = byte & 0x7F
                while byte & 0x80:
                    byte, at = pack[at], at + 1
                    back = (back + 1 << 7) | byte & 0x7F
                changes.append(self._inflated(pack, at))
                at = start - back
            elif kind == NAME_DELTA:
                base = pack[at : at + 20].hex()
                changes.append(self._inflated(pack, at + 20))
                name, content = self.read(base)
                break
            else:
                name, content = KINDS[kind], self._inflated(pack, at)
                break
        for change in reversed(changes):
            content = _applied(content, change)
        return name, content

    @staticmethod
    def _inflated(pack: mmap.mmap, at: int) -> bytes:
        stream, parts = zlib.decompressobj(), []
        while not stream.eof:
            chunk = pack[at : at + 65536]
            if not chunk:
                raise ValueError("a pack ends within an object")
            parts.append(stream.decompress(chunk))
            at += len(chunk)
        return b"".join(parts)

    def tree(self, oid: str, under: str = ""):
        """(path, mode, oid) of the entries of one folder."""
        content, at = self.read(oid)[1], 0
        while at < len(content):
            end = content.index(b"\0", at)
            mode, name = content[at:end].split(b" ", 1)
            yield under + name.decode("utf-8", "replace"), int(mode, 8), content[end + 1 : end + 21].hex()
            at = end + 21

    def files(self, path: str, mode: int, oid: str):
        """(path, mode, oid) of a file, or of all files below a folder."""
        waiting = [(path, mode, oid)]
        while waiting:
            path, mode, oid = waiting.pop()
            if mode >> 12 == FOLDER:
                waiting += self.tree(oid, path + "/")
            else:
                yield path, mode, oid

    def root_of(self, commit: str) -> str:
        kind, content = self.read(commit)
        while kind == "tag":
            kind, content = self.read(content.split(b"\n", 1)[0].split(b" ")[1].decode())
        return content.split(b"\n", 1)[0].split(b" ")[1].decode()

    def index(self):
        """(path, mode, oid) of what is staged: no conflicts, and nothing that is only meant to be added."""
        try:
            with open(os.path.join(self.own, "index"), "rb") as f:
                data = f.read()
        except FileNotFoundError:
            return
        mark, version, count = struct.unpack_from(">4sII", data)
        if mark != b"DIRC" or version not in (2, 3, 4):
            raise ValueError("no index of version 2 to 4")
        at, path = 12, b""
        for _ in range(count):
            start = at
            mode, oid, flags = struct.unpack_from(">24xI12x20sH", data, at)
            at, more = at + 62, 0
            if flags & 0x4000:
                more, at = struct.unpack_from(">H", data, at)[0], at + 2
            if version == 4:  # how many bytes of the path before are cut off, then what follows them
                byte, at = data[at], at + 1
                cut = byte & 0x7F
                while byte & 0x80:
                    byte, at = data[at], at + 1
                    cut = (cut + 1 << 7) | byte & 0x7F
                end = data.index(b"\0", at)
                path, at = path[: len(path) - cut] + data[at:end], end + 1
            else:
                end = data.index(b"\0", at)
                path, at = data[at:end], start + ((end - start) // 8 + 1) * 8
            if not flags >> 12 & 3 and not more & 0x2000:
                yield from self.files(path.decode("utf-8", "replace").rstrip("/"), mode, oid.hex())
        while at + 28 <= len(data):  # extensions, then a checksum of 20 bytes
            name, size = struct.unpack_from(">4sI", data, at)
            if name == b"link":
                raise ValueError("an index split over two files is not read")
            at += 8 + size


def _applied(base: bytes, change: bytes) -> bytes:
    """A difference: two sizes, then copies of the base (high bit) and insertions."""

    def size(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = change[at], at + 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if not byte & 0x80:
                return value, at

    at, out = size(size(0)[1])[1], []
    while at < len(change):
        byte, at = change[at], at + 1
        if byte & 0x80:
            fields = []
            for bit in range(7):
                fields.append(change[at] if byte >> bit & 1 else 0)
                at += byte >> bit & 1
            start, n = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            out.append(base[start : start + n])
        else:
            out.append(change[at : at + byte])
            at += byte
    return b"".join(out)


class Part(InputPartition):
    def __init__(self, entry: tuple[str, int, str] | None):
        self.entry = entry


class EntryReader(DataSourceReader):
    def __init__(self, root: str, tree: str):
        self.root, self.tree = root, tree

    def partitions(self):
        if self.tree == "index":
            return [Part(None)]
        repository = Repository(self.root)
        commit = repository.commit_of(self.tree)
        return [Part(e) for e in repository.tree(repository.root_of(commit))] if commit else [Part(("", -1, ""))]

    def read(self, partition):
        if partition.entry is None:
            yield from Repository(self.root).index()
        elif partition.entry[1] >= 0:
            yield from Repository(self.root).files(*partition.entry)


class GitEntries(DataSource):
    """Options: path (the repository), tree (``index``, or a commit, branch, tag or ``HEAD``)."""

    @classmethod
    def name(cls) -> str:
        return "git_entries"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return EntryReader(self.options["path"], self.options.get("tree", "index"))


def entries(spark: SparkSession, root: str, tree: str = "index") -> DataFrame:
    """path, mode, oid of the files in the index or in a commit."""
    spark.dataSource.register(GitEntries)
    return spark.read.format("git_entries").option("path", os.path.abspath(root)).option("tree", tree).load()


def staged(spark: SparkSession, root: str, against: str = "HEAD") -> DataFrame:
    """path, status, old_path, before, after: what the index changes.

    status: ``added``, ``modified``, ``deleted``, ``renamed`` (added under this path with the
    content that a deleted one had, of which the first is ``old_path``) or ``retyped`` (a link
    became a file or the like). before and after: texts, null where there is none or it is no
    UTF-8. A file that is renamed and edited at once is an added one and a deleted one.
    Submodules have no text. Only what differs is read.
    """
    side = lambda tree, name: entries(spark, root, tree).select("path", F.col("mode").alias(f"{name}_mode"), F.col("oid").alias(f"{name}_oid"))
    both = side(against, "before").join(side("index", "after"), "path", "full")
    both = both.filter(~(F.col("before_oid").eqNullSafe(F.col("after_oid")) & F.col("before_mode").eqNullSafe(F.col("after_mode"))))
    kind = lambda c: F.shiftright(F.col(c), 12)
    status = F.when(F.col("before_oid").isNull(), "added").when(F.col("after_oid").isNull(), "deleted").when(kind("before_mode") != kind("after_mode"), "retyped").otherwise("modified")
    both = both.withColumn("status", status)
    gone = both.filter("status = 'deleted'").groupBy(F.col("before_oid").alias("gone")).agg(F.min("path").alias("old_path"))
    moved = (F.col("status") == "added") & (F.col("after_oid") == F.col("gone"))
    both = both.join(gone, moved, "left").withColumn("status", F.when(F.col("gone").isNotNull(), "renamed").otherwise(F.col("status")))
    both = both.withColumn("before_oid", F.coalesce("before_oid", "gone"))
    has = lambda name: F.when(kind(f"{name}_mode").isin(FILE, LINK) | F.col(f"{name}_mode").isNull(), F.col(f"{name}_oid"))
    wanted = both.select("path", "status", "old_path", has("before").alias("before"), has("after").alias("after"))

    def read(batches):
        repository = Repository(os.path.abspath(root))

        def text(oid: str | None) -> str | None:
            try:
                return repository.read(oid)[1].decode("utf-8") if oid else None
            except UnicodeDecodeError:
                return None

        for b in batches:
            for i in range(len(b)):  # a row at a time: two whole files each
                one = b.iloc[i : i + 1].astype(object)
                yield pd.DataFrame(one.assign(before=[text(x) for x in one["before"]], after=[text(x) for x in one["after"]]))

    return wanted.repartition("path").mapInPandas(read, "path string, status string, old_path string, before string, after string")


def commit_decisions(spark: SparkSession, root: str, rules: list[dict] | None = None, **options) -> DataFrame:
    """``decision.decide_writes`` of what is staged: files added or modified, against what they are at HEAD; deny refuses the commit.

    Fixable flags alone don't refuse one. A renamed file is as it was and isn't judged.
    """
    from ..operators.decision import decide_writes
    from ..operators.routing import DEFAULT_RULES

    changed = staged(spark, root).filter(F.col("status").isin("added", "modified") & F.col("after").isNotNull())
    none = F.lit(None).cast("string")
    writes = changed.select("path", F.lit("write").alias("tool"), "before", F.col("after").alias("content"), none.alias("old"), none.alias("new"), F.lit(False).alias("every"))
    return decide_writes(writes, rules or [*DEFAULT_RULES], **options)
