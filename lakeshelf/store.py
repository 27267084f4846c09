"""A shelf: records and bytes in Parquet, changed through an append-only log.

A change is a new segment of the log. Segments are written aside and published by a rename, chunks
before changes, so that a crash leaves at most bytes that prune_orphans removes. The present state
is the rows of the base that compaction wrote, but for ids with changes since, and the last change of
each of those; filters on it reach the scans of both. Which rows count is found by keys alone, and the
rows themselves are then picked where they lie (see sieve), so reading moves no texts or bytes that it
doesn't return. The shelf's own state is in numbered files, of which the newest counts. There is one
writer at a time; readers see published segments only.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeshelf.errors import ClosedError, NotFoundError, ValidationError, translate_storage_error
from lakeshelf.functions import mime as M
from lakeshelf.functions.misc import chunk_count, normalize_name, normalize_tags, now_ms, to_timestamp
from lakeshelf.functions.paths import canonical_json, metadata_text, normalize_folder, normalize_metadata
from lakeshelf.functions.text import normalize_text
from lakeshelf.operators import aggregates, chunks as C, select
from lakeshelf.operators.ingest import Options, check_kind, derive, prepare, repeated, search_columns
from lakeshelf.operators.select import Query
from lakeshelf.operators.sieve import at_places, lacking
from lakeshelf.schema import CHUNKS, FILES, SEARCH_COLUMNS, THUMBNAILS
from lakeshelf.sources.tables import binary_files
from lakeshelf.streaming.feed import CHANGES, Emitter, follow, read_changes

VERSION = 4
_NAMES = [f.name for f in FILES]
_STORED_CHUNKS = T.StructType([*CHUNKS.fields, T.StructField("seq", T.LongType())])
#: So many records of a change come to the driver at once; more are read as they are asked for.
_AT_ONCE = 10_000


def _place() -> tuple[Column, Column]:
    """Where a row of a table lies."""
    return F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row")


class Records(Sequence):
    """The records of a large change in order, read from the log as they are asked for."""

    def __init__(self, rows: DataFrame, number: int):
        self._rows, self._number, self._read = rows, number, None

    def __len__(self) -> int:
        return self._number

    def __iter__(self) -> Iterator[dict]:
        return (record(r.asDict(True)) for r in self._rows.toLocalIterator())

    def __getitem__(self, at):
        if self._read is None:
            self._read = list(self)
        return self._read[at]


class Shelf:
    def __init__(self, spark: SparkSession, root: str, **defaults: object):
        self.spark, self.root = spark, root.rstrip("/")
        self.options = Options(**defaults)  # type: ignore[arg-type]
        self.source = uuid.uuid4().hex
        self.events = Emitter()
        self._open = False
        self.on, self.once, self.off = self.events.on, self.events.once, self.events.off

    # --- life ---

    def open(self) -> Shelf:
        if not self._open:
            state = self._read_state()
            if state is None:
                self._write_state({"version": VERSION, "epoch": 0})
            elif state.get("version", 0) > VERSION:
                raise ValidationError(f"the shelf is of version {state['version']}, which is newer than {VERSION}")
            elif state.get("version", 0) < VERSION:
                self._upgrade(state)
            self._open = True
            self.events.emit("open")
        return self

    def _upgrade(self, state: dict) -> None:
        """To the present version: the log's order within a batch has its own column since version 4,
        contents are keyed by their hash since version 3."""
        folder = f"{self.root}/epoch-{state['epoch']}"
        if state.get("version", 0) < 3 and self._fs(self.root).exists(self._path(f"{folder}/chunks")):
            old = self.spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/chunks")
            if "file_id" in old.columns:
                log = self.spark.read.schema(CHANGES).option("recursiveFileLookup", "true").parquet(f"{folder}/changes")
                files = log.groupBy("id").agg(F.max_by("record", "seq").alias("r")).select("r.*")
                moved = f"{self.root}/epoch-{state['epoch'] + 1}"
                C.migrate(old, files).withColumn("seq", F.lit(0).cast("long")).write.parquet(f"{moved}/chunks/0")
                log.withColumn("record", F.col("record").withField("content_id", F.coalesce("record.hash", "record.id"))).write.parquet(f"{moved}/changes/0")
                state = state | {"epoch": state["epoch"] + 1}
        self._write_state(state | {"version": VERSION})

    def close(self) -> None:
        if self._open:
            self._open = False
            self.events.emit("close")

    def destroy(self) -> None:
        self.close()
        self._fs(self.root).delete(self._path(self.root), True)
        self.events.emit("destroy")

    def __enter__(self) -> Shelf:
        return self.open()

    def __exit__(self, *_: object) -> None:
        self.close()

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self, name: str):
        return self._path(name).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs(self.root).exists(self._path(f"{self.root}/{name}"))

    def _state_files(self) -> list[str]:
        """Names of the shelf's state files, the newest last; the first version had one without a number."""
        fs, root = self._fs(self.root), self._path(self.root)
        names = [f.getPath().getName() for f in fs.listStatus(root)] if fs.exists(root) else []
        own = [n for n in names if n.startswith("_shelf") and n.endswith(".json")]
        return sorted(own, key=lambda n: int(n.removeprefix("_shelf").removesuffix(".json").lstrip("-") or 0))

    def _write_state(self, state: dict) -> None:
        """A new state file, complete before it gets its name; older ones go after it is there."""
        fs, have = self._fs(self.root), self._state_files()
        number = 1 + (int(have[-1].removeprefix("_shelf").removesuffix(".json").lstrip("-") or 0) if have else 0)
        aside = self._path(f"{self.root}/_aside/{uuid.uuid4().hex}")
        stream = fs.create(aside, True)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        if not fs.rename(aside, self._path(f"{self.root}/_shelf-{number:012d}.json")):
            raise translate_storage_error(OSError("the shelf's state can't be written"))
        for name in have[:-1]:
            fs.delete(self._path(f"{self.root}/{name}"), False)

    def _read_state(self) -> dict | None:
        have = self._state_files()
        if not have:
            return None
        stream = self._fs(self.root).open(self._path(f"{self.root}/{have[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _state(self) -> dict:
        if not self._open:
            raise ClosedError("open the shelf first")
        return self._read_state() or {"version": VERSION, "epoch": 0}

    def _folder(self, name: str) -> str:
        return f"{self.root}/epoch-{self._state()['epoch']}/{name}"

    def _publish(self, rows: DataFrame, name: str, even_empty: bool = True) -> None:
        to = self._folder(name)
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        try:
            rows.write.option("compression", "zstd").parquet(aside)
        except Exception as error:
            raise translate_storage_error(error) from error
        fs = self._fs(self.root)
        if not even_empty and self.spark.read.schema(rows.schema).parquet(aside).isEmpty():
            fs.delete(self._path(aside), True)
            return
        fs.mkdirs(self._path(to))
        fs.rename(self._path(aside), self._path(f"{to}/{now_ms():015d}-{uuid.uuid4().hex}"))

    def _has(self, name: str) -> bool:
        return self._fs(self.root).exists(self._path(self._folder(name)))

    def _table(self, name: str, schema) -> DataFrame:
        if not self._has(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(self._folder(name))

    # --- tables ---

    def changes(self) -> DataFrame:
        return self._table("changes", CHANGES)

    def files(self) -> DataFrame:
        """The present rows: of each id the last change, unless it purged it; and the base's other rows."""
        return self._files()

    def _files(self, some: Callable[[DataFrame], DataFrame] | None = None, before: int | None = None) -> DataFrame:
        """The present rows, or those as of a seq; some: a filter by id, of any table that has one. What
        is shuffled is ids and places, no record."""
        some, changed, based, out = some or (lambda keys: keys), self._has("changes"), self._has("base"), None
        changes = self.changes() if before is None else self.changes().where(F.col("seq") <= before)
        if changed:
            keys = some(changes.select("id", "seq", "sub", "type", *_place()))
            last = keys.groupBy("id").agg(F.max(F.struct("seq", "sub", "type", "_file", "_row")).alias("l")).where("l.type <> 'purge'")
            out = at_places(changes.select("record", *_place()), last.select("l._file", "l._row"), ["_file"], "_row").select("record.*")
        if based:
            base = self._table("base", FILES)
            rest = some(base.select("id", *_place()))
            if changed:
                rest = rest.join(changes.select("id").distinct(), "id", "left_anti")
            rows = at_places(base.select(*_NAMES, *_place()), rest, ["_file"], "_row").select(*_NAMES)
            out = rows if out is None else rows.unionByName(out)
        return self._table("base", FILES) if out is None else out

    def _voided(self) -> DataFrame:
        """Stretches of the log that transactions took back; one row for each that failed."""
        return self._table("voided", "low long, high long")

    def _standing(self, rows: DataFrame) -> DataFrame:
        """Rows with a seq that no failed transaction wrote."""
        if not self._has("voided"):
            return rows
        gone = F.broadcast(self._voided())
        return rows.join(gone, (rows["seq"] > gone["low"]) & (rows["seq"] <= gone["high"]), "left_anti")

    def chunks(self) -> DataFrame:
        """Chunks that weren't released since they were written."""
        if not self._has("chunks"):
            return self._table("chunks", CHUNKS)
        rows = self._standing(self._table("chunks", _STORED_CHUNKS).select("*", *_place()))
        if self._has("released"):
            gone = self._standing(self._table("released", "content_id string, seq long")).groupBy("content_id").agg(F.max("seq").alias("_gone"))
            lost = rows.select("content_id", "seq", "_file", "_row").join(gone, "content_id").where("seq <= _gone").select("_file", "_row")
            rows = at_places(rows, lost, ["_file"], "_row", inside=False)
        return rows.select("content_id", "index", "data")

    def thumbnails(self) -> DataFrame:
        if not self._has("thumbnails"):
            return self._table("thumbnails", THUMBNAILS)
        rows = self._table("thumbnails", THUMBNAILS).select("*", *_place())
        last = rows.groupBy("id").agg(F.max(F.struct("created_at", F.col("blob").isNull().alias("hidden"), "_file", "_row")).alias("l")).where("not l.hidden")
        return at_places(rows, last.select("l._file", "l._row"), ["_file"], "_row").select(*THUMBNAILS.names)

    def _next_seq(self) -> int:
        state = self._state()
        state["seq"] = state.get("seq", 0) + 1
        self._write_state(state)
        return state["seq"] << 32

    def _publish_rows(self, rows: DataFrame, kind: str) -> int:
        """Publishes one change for each row without bringing them to the driver; the changes' seq."""
        seq = self._next_seq()
        log = rows.select(F.lit(seq).alias("seq"), F.monotonically_increasing_id().alias("sub"), F.lit(now_ms()).alias("ts"), F.lit(kind).alias("type"), F.lit(self.source).alias("source"), "id", F.struct(*_NAMES).alias("record"))
        self._publish(log, "changes")
        return seq

    def _changed(self, rows: DataFrame, kind: str) -> Sequence[dict]:
        """Publishes changed rows and tells listeners, if there are any; the records as callers see them,
        without texts."""
        return self._told(self._publish_rows(rows, kind), kind)

    def _told(self, seq: int, kind: str) -> Sequence[dict]:
        shown = [n for n in _NAMES if n not in _HIDDEN]
        log = self.changes().where(F.col("seq") == seq)
        number = log.count()
        found = log.orderBy("sub").select(*(F.col(f"record.{n}").alias(n) for n in shown))
        records = [record(r.asDict(True)) for r in found.collect()] if number <= _AT_ONCE else Records(found, number)
        if self.events.listener_count(kind) or self.events.listener_count("change"):
            for r in records:
                self._emit(kind, r)
        return records

    def _of(self, ids: Iterable[str] | DataFrame) -> DataFrame:
        """The present rows of those ids, which may be a table with an id as well."""
        if not isinstance(ids, DataFrame):
            ids = list(dict.fromkeys(ids))
            if len(ids) <= 1000:
                return self.files().where(F.col("id").isin(*ids) if ids else F.lit(False))
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        own = ids.select("id")
        return self._files(lambda keys: keys.join(own, "id", "left_semi"))

    def _log(self, kind: str, rows: list[dict]) -> list[dict]:
        """Publishes one change for each row and tells listeners."""
        seq, ts = self._next_seq(), now_ms()
        data = [(seq, k, ts, kind, self.source, r["id"], tuple(r.get(n) for n in _NAMES)) for k, r in enumerate(rows)]
        if data:
            self._publish(self.spark.createDataFrame(data, CHANGES).coalesce(1), "changes")
        records = [record(r) for r in rows]
        for r in records:
            self._emit(kind, r)
        return records

    def _emit(self, kind: str, payload: dict) -> None:
        self.events.emit(kind, payload)
        if kind != "duplicate":
            self.events.emit("change", {"type": kind, "record": payload, "remote": False})

    def _rows(self, ids: Iterable[str]) -> dict[str, dict]:
        ids = list(dict.fromkeys(ids))
        found = self.files().where(F.col("id").isin(*ids)).collect() if ids else []
        return {r["id"]: r.asDict(True) for r in found}

    def _row(self, id: str) -> dict:
        rows = self._rows([id])
        if id not in rows:
            raise NotFoundError(f"no record {id!r}")
        return rows[id]

    # --- writing ---

    def add(self, data: object, **options: object) -> dict:
        """Adds one payload; its record. With dedupe a live record of the same bytes comes back instead."""
        return self.add_many([data], **options)[0]

    def add_many(self, items: Iterable[object], progress: Callable | None = None, **options: object) -> list[dict]:
        """Adds payloads as one batch; their records in order."""
        self._state()
        made = [prepare(item, options, self.options) for item in items]
        ids = [row["id"] for row, _ in made]
        if len(set(ids)) < len(ids):
            raise ValidationError("one id can't serve many records")
        same: dict[str, dict] = {}
        if options.get("dedupe", self.options.dedupe):
            hashes = sorted({row["hash"] for row, _ in made if row["hash"]})
            live = self.files().where(F.col("hash").isin(*hashes) & (F.col("deleted_at") == 0)) if hashes else self.files().where("false")
            shown = [n for n in _NAMES if n not in _HIDDEN]
            first = live.groupBy("hash").agg(F.min_by(F.struct(*shown), F.struct("created_at", "id")).alias("r"))
            same = {r.hash: record(r.r.asDict(True)) for r in first.collect()}
        new: dict[str, tuple[dict, bytes]] = {}
        for row, raw in made:
            if options.get("dedupe", self.options.dedupe) and row["hash"]:
                if row["hash"] in same:
                    continue
                same[row["hash"]] = record(row)
            new[row["id"]] = (row, raw)
        if new and (clash := self._of(new).select("id").limit(1).collect()):
            raise ValidationError(f"there is a record {clash[0].id!r} already")
        self._store_many(list(new.values()))
        records = {r["id"]: r for r in self._log("add", [row for row, _ in new.values()])}
        out = []
        for k, (row, _) in enumerate(made):
            out.append(records.get(row["id"]) or same[row["hash"]])
            if row["id"] not in records:
                self._emit("duplicate", out[-1])
            if progress:
                progress(k + 1, len(made), out[-1])
        return out

    def _store(self, row: dict, raw: bytes) -> None:
        self._store_many([(row, raw)])

    def _store_many(self, items: list[tuple[dict, bytes]]) -> None:
        """Writes the rows' contents, or takes over the layout in which they are stored already."""
        contents = sorted({row["content_id"] for row, _ in items})
        if not contents:
            return
        own = F.col("content_id").isin(*contents)
        stored = {r.content_id for r in self.chunks().where(own).select("content_id").distinct().collect()}
        owners = self.files().where(own).groupBy("content_id").agg(F.first(F.struct("chunk_size", "chunk_count")).alias("l")).collect()
        layouts = {r.content_id: r.l for r in owners if r.content_id in stored}
        stale = [c for c in contents if c not in layouts]
        self._release([c for c in stale if c in stored])
        fresh: dict[str, tuple[str, bytearray, int]] = {}
        for row, raw in items:
            if layout := layouts.get(row["content_id"]):
                row["chunk_size"], row["chunk_count"] = layout.chunk_size, layout.chunk_count
            elif row["content_id"] not in fresh:
                fresh[row["content_id"]] = (row["content_id"], bytearray(raw), row["chunk_size"])
            else:
                first = fresh[row["content_id"]]
                row["chunk_size"], row["chunk_count"] = first[2], chunk_count(row["size"], first[2])
        if fresh:
            content = self.spark.createDataFrame(list(fresh.values()), "content_id string, data binary, chunk_size long")
            self._publish(C.split(content, F.col("chunk_size")).withColumn("seq", F.lit(self._next_seq())), "chunks")

    def _release(self, content_ids: list[str]) -> None:
        """Lets go of those contents that no record refers to."""
        if content_ids:
            self._release_rows(self.spark.createDataFrame([(c,) for c in set(content_ids)], "content_id string"))

    def _release_rows(self, contents: DataFrame) -> None:
        gone = contents.distinct().join(self.files().select("content_id"), "content_id", "left_anti")
        self._publish(gone.withColumn("seq", F.lit(self._next_seq())), "released", even_empty=False)

    def ingest(self, raw: DataFrame, dedupe_by_hash: bool | None = None) -> int:
        """Adds many payloads (see derive) in one batch, without the driver seeing them; their number."""
        rows, files = derive(raw, self.options), self.files()
        aside = f"{self.root}/_aside/{uuid.uuid4().hex}"
        try:
            rows.select("id", "hash", "content_id").write.option("compression", "zstd").parquet(f"{aside}/0")
        except Exception as error:
            raise translate_storage_error(error) from error
        keys = self.spark.read.parquet(f"{aside}/0")
        try:
            clash = keys.groupBy("id").count().where("count > 1").select("id")
            if self._has("changes") or self._has("base"):
                clash = keys.select("id").join(files.select("id"), "id", "left_semi").unionByName(clash)
            if clash := clash.limit(1).collect():
                raise ValidationError(f"there is a record {clash[0].id!r} already, or more than one in the batch")
            if self.options.dedupe if dedupe_by_hash is None else dedupe_by_hash:
                repeated(keys, files).write.parquet(f"{aside}/1")
                twice = self.spark.read.parquet(f"{aside}/1")
                rows, keys = lacking(rows, twice, "id", keys), keys.join(twice, "id", "left_anti")
            # the contents of these ids are there already, or come with a smaller id
            first = keys.groupBy("content_id").agg(F.min("id").alias("_first"))
            stored = keys.join(first, "content_id").where("id <> _first").select("id")
            if self._has("chunks"):
                stored = stored.unionByName(keys.join(self.chunks().select("content_id"), "content_id", "left_semi").select("id")).distinct()
            stored.write.parquet(f"{aside}/2")
            new = lacking(rows, self.spark.read.parquet(f"{aside}/2"), "id", keys)
            self._publish(C.split(new, F.col("chunk_size"), "content").withColumn("seq", F.lit(self._next_seq())), "chunks")
            self._publish_rows(rows, "add")
            return keys.count()
        finally:
            self._fs(self.root).delete(self._path(aside), True)

    def import_files(self, path: str, preserve_relative_path: bool = True, **options: object) -> int:
        """Adds all files below a directory; their number."""
        raw = binary_files(self.spark, path)
        base = normalize_folder(options.get("folder"))  # type: ignore[arg-type]
        raw = raw.withColumn("folder", F.concat(F.lit(base + "/"), F.col("folder") if preserve_relative_path else F.lit("")))
        if options.get("tags"):
            raw = raw.withColumn("tags", F.array(*(F.lit(t) for t in options["tags"])))  # type: ignore[union-attr]
        return self.ingest(raw, options.get("dedupe"))  # type: ignore[arg-type]

    def update(self, id: str, **options: object) -> dict:
        self._row(id)
        return self.update_many([id], **options)[0]

    def _updated(self, row: dict, options: dict) -> dict:
        o, old = options, row["content_id"]
        row = dict(row)
        if o.get("data") is not None:
            new, raw = prepare(o["data"], {**o, "name": o.get("name") or row["name"], "mime": o.get("mime") or row["mime"], "id": row["id"]}, self.options)
            for c in ("content_id", "mime", "extension", "kind", "hash", "text", "width", "height", "duration_ms", "size", "chunk_size", "chunk_count"):
                row[c] = new[c]
            self._store(row, raw)
        if o.get("name") is not None:
            row["name"] = normalize_name(o["name"])
            row["extension"] = M.extension_of(row["name"])
        if o.get("mime") is not None:
            row["mime"] = M.normalize_mime(o["mime"])
        if o.get("kind") is not None:
            row["kind"] = check_kind(o["kind"])
        if o.get("tags") is not None:
            row["tags"] = normalize_tags(o["tags"])
        if o.get("folder") is not None:
            row["folder"] = normalize_folder(o["folder"])
        if o.get("favorite") is not None:
            row["favorite"] = int(bool(o["favorite"]))
        if o.get("notes") is not None:
            row["notes"] = o["notes"]
        if o.get("metadata") is not None:
            row["metadata"] = canonical_json(normalize_metadata(o["metadata"]))
        if "text" in o:
            row["text"] = o["text"] or ""
        for c in ("width", "height", "duration_ms"):
            if c in o:
                row[c] = o[c]
        row["revision"] += 1
        row["updated_at"] = to_timestamp(o.get("updated_at")) or now_ms()
        row |= search_columns(row)
        if row["content_id"] != old:
            self._stale = [*getattr(self, "_stale", []), old]
        return row

    def update_many(self, ids: Iterable[str], **options: object) -> list[dict]:
        """The same change for many records; ids that aren't there are passed over."""
        if options.get("data") is not None:  # a payload comes from the driver, as its row may
            out = self._log("update", [self._updated(r, options) for r in self._rows(ids).values()])
            self._release(self.__dict__.pop("_stale", []))
            return out
        o = options
        new: dict[str, object] = {}
        if o.get("name") is not None:
            new["name"] = normalize_name(o["name"])
            new |= {"extension": M.extension_of(new["name"]), "name_lower": normalize_text(new["name"])}
        if o.get("mime") is not None:
            new["mime"] = M.normalize_mime(o["mime"])
        if o.get("kind") is not None:
            new["kind"] = check_kind(o["kind"])
        if o.get("folder") is not None:
            new["folder"] = normalize_folder(o["folder"])
        if o.get("favorite") is not None:
            new["favorite"] = int(bool(o["favorite"]))
        if o.get("notes") is not None:
            new |= {"notes": o["notes"], "notes_lower": normalize_text(o["notes"])}
        if o.get("metadata") is not None:
            value = normalize_metadata(o["metadata"])
            new |= {"metadata": canonical_json(value), "meta_text": normalize_text(metadata_text(value))}
        if "text" in o:
            new |= {"text": o["text"] or "", "text_lower": normalize_text(o["text"] or "")}
        new |= {c: o[c] for c in ("width", "height", "duration_ms") if c in o}
        new["updated_at"] = to_timestamp(o.get("updated_at")) or now_ms()
        columns = {c: F.lit(v).cast(FILES[c].dataType) for c, v in new.items()}
        if o.get("tags") is not None:
            tags = normalize_tags(o["tags"])
            columns["tags"] = F.array(*(F.lit(t) for t in tags)).cast("array<string>")
            columns["tags_key"] = F.array(*(F.lit(t.lower()) for t in tags)).cast("array<string>")
            columns["tags_lower"] = F.lit(normalize_text(" ".join(tags)))
        return self._changed(self._of(ids).withColumns(columns | {"revision": F.col("revision") + 1}), "update")

    def set_tags(self, id: str, add: Iterable[str] = (), remove: Iterable[str] = ()) -> dict:
        """Takes tags off, then puts tags on; a tag in both is on."""
        row = self._row(id)
        off = {t.lower() for t in normalize_tags(list(remove))}
        return self._log("update", [self._updated(row, {"tags": [t for t in row["tags"] if t.lower() not in off] + list(add)})])[0]

    def move(self, ids: Iterable[str], folder: str) -> list[dict]:
        return self.update_many(ids, folder=normalize_folder(folder))

    def set_favorite(self, ids: Iterable[str], favorite: bool = True) -> list[dict]:
        return self.update_many(ids, favorite=favorite)

    def _mark(self, ids: Iterable[str] | DataFrame, kind: str, deleted_at: int) -> Sequence[dict]:
        new = {"deleted_at": F.lit(deleted_at).cast("long"), "revision": F.col("revision") + 1, "updated_at": F.lit(now_ms())}
        return self._changed(self._of(ids).withColumns(new), kind)

    def trash(self, ids: Iterable[str]) -> list[dict]:
        return self._mark(ids, "delete", now_ms())

    def restore(self, ids: Iterable[str]) -> list[dict]:
        return self._mark(ids, "restore", 0)

    def purge(self, ids: Iterable[str]) -> int:
        """Removes records, their previews, and the contents that no record refers to any more."""
        return len(self._purge(self._of(ids), True))

    def _purge(self, rows: DataFrame, tell: bool) -> Sequence[dict]:
        seq = self._publish_rows(rows, "purge")
        records = self._told(seq, "purge") if tell else []
        gone = self.changes().where(F.col("seq") == seq)
        self._release_rows(gone.select("record.content_id"))
        if self._has("thumbnails"):
            self._hide_previews(self.thumbnails().join(gone.select("id"), "id", "left_semi"))
        return records

    def _hide_previews(self, previews: DataFrame) -> None:
        when = F.greatest(F.lit(now_ms()), F.col("created_at") + 1)
        self._publish(previews.select("id", F.lit(None).cast("binary").alias("blob"), "width", "height", when.alias("created_at")), "thumbnails", even_empty=False)

    def empty_trash(self) -> int:
        """Purges all trashed records without bringing them to the driver."""
        gone = self.files().where("deleted_at > 0")
        n = gone.count()
        if n:
            self._purge(gone, False)
        return n

    def clear(self) -> None:
        """A new, empty epoch."""
        state = self._state()
        old = f"{self.root}/epoch-{state['epoch']}"
        self._write_state(state | {"epoch": state["epoch"] + 1})
        self._fs(self.root).delete(self._path(old), True)

    def prune_orphans(self) -> dict:
        """Removes bytes and previews without a record; how many of each."""
        lost = C.orphans(self.chunks(), self.files())
        n_chunks = lost.count()
        if n_chunks:
            self._publish(lost.select("content_id").distinct().withColumn("seq", F.lit(self._next_seq())), "released")
        previews = C.orphan_thumbnails(self.thumbnails(), self.files())
        n_previews = previews.count()
        if n_previews:
            self._hide_previews(previews)
        return {"chunks": n_chunks, "thumbnails": n_previews}

    def set_thumbnail(self, id: str, blob: bytes, width: int, height: int) -> None:
        self._row(id)
        self._publish(self.spark.createDataFrame([(id, bytearray(blob), width, height, now_ms())], THUMBNAILS), "thumbnails")

    def compact(self) -> None:
        """Rewrites the present state as the base of a new epoch, without old changes and released bytes."""
        state = self._state()
        old, new = f"{self.root}/epoch-{state['epoch']}", f"{self.root}/epoch-{state['epoch'] + 1}"
        # sorted within files, so that filters on folder skip row groups
        self.files().select(*_NAMES).sortWithinPartitions("folder", "id").write.option("compression", "zstd").parquet(f"{new}/base/0")
        self.chunks().withColumn("seq", F.lit(0).cast("long")).write.option("compression", "zstd").parquet(f"{new}/chunks/0")
        if self._has("thumbnails"):
            self.thumbnails().write.option("compression", "zstd").parquet(f"{new}/thumbnails/0")
        self._write_state(state | {"epoch": state["epoch"] + 1})
        self._fs(self.root).delete(self._path(old), True)

    def transaction(self, body: Callable[[Shelf], object]) -> object:
        """Runs body; if it fails, what it published doesn't count: contents that it wrote or released
        are as they were, and its changes are hidden by a return to the rows before. Previews stay."""
        before = self._state().get("seq", 0) << 32
        try:
            return body(self)
        except Exception:
            self._publish(self.spark.createDataFrame([(before, self._state().get("seq", 0) << 32)], "low long, high long"), "voided")
            own = self.changes().where(F.col("seq") > before).select("id").distinct()
            old = self._files(lambda keys: keys.join(own, "id", "left_semi"), before).select("id", F.struct(*_NAMES).alias("record"))
            back = old.unionByName(own.join(old.select("id"), "id", "left_anti").withColumn("record", F.lit(None).cast(FILES)))
            seq = self._next_seq()
            kind = F.when(F.col("record").isNull(), "purge").otherwise("update")
            self._publish(back.select(F.lit(seq).alias("seq"), F.monotonically_increasing_id().alias("sub"), F.lit(now_ms()).alias("ts"), kind.alias("type"), F.lit(self.source).alias("source"), "id", "record"), "changes")
            raise

    # --- reading ---

    def find(self, id: str, touch: bool = False, include_text: bool = False, include_blob: bool = False, include_thumbnail: bool = False) -> dict | None:
        row = self._rows([id]).get(id)
        if row is None:
            return None
        if touch:
            row["accessed_at"] = now_ms()
            seq = self._next_seq()
            self._publish(self.spark.createDataFrame([(seq, 0, now_ms(), "touch", self.source, id, tuple(row[n] for n in _NAMES))], CHANGES), "changes")
        out = record(row)
        if include_text:
            out["text"] = row["text"]
        if include_blob:
            out["blob"] = self.get_blob(id)
        if include_thumbnail:
            out["thumbnail"] = self.get_thumbnail(id)
        return out

    def get(self, id: str, **options: bool) -> dict:
        found = self.find(id, **options)
        if found is None:
            raise NotFoundError(f"no record {id!r}")
        return found

    def has(self, id: str) -> bool:
        return not self.files().where((F.col("id") == id) & (F.col("deleted_at") == 0)).isEmpty()

    def get_blob(self, id: str) -> bytes:
        row = self._row(id)
        found = C.assemble(self.chunks().where(F.col("content_id") == row["content_id"])).collect()
        if not found:
            raise NotFoundError(f"no content of {id!r}")
        return bytes(found[0].data)

    def read_range(self, id: str, start: int, end: int) -> bytes:
        row = self._row(id)
        found = C.read_range(self.chunks(), row["content_id"], row["chunk_size"], row["size"], start, end).collect()
        if not found and start < min(end, row["size"]):
            raise NotFoundError(f"no content of {id!r}")
        return bytes(found[0].data) if found else b""

    def get_text(self, id: str) -> str:
        return self._row(id)["text"]

    def get_thumbnail(self, id: str) -> bytes | None:
        found = self.thumbnails().where(F.col("id") == id).select("blob").collect()
        return bytes(found[0].blob) if found else None

    def export_file(self, id: str, folder: str) -> str:
        """Writes a record's bytes below a local folder; the path."""
        path = PurePosixPath(folder) / PurePosixPath(self._row(id)["name"]).name
        with open(path, "wb") as file:
            file.write(self.get_blob(id))
        return str(path)

    def list(self, **query: object):
        return select.select_page(self.files(), Query(**query), self.chunks(), self.thumbnails())  # type: ignore[arg-type]

    def walk(self, **query: object) -> select.Walk:
        """All pages of a query at once (see select.walk); its rows are kept beside the shelf's tables."""
        return select.walk(self.files(), Query(**query), f"{self.root}/_aside/{uuid.uuid4().hex}")  # type: ignore[arg-type]

    def all(self, **query: object) -> DataFrame:
        return self.list(**{**query, "limit": float("inf"), "offset": 0, "cursor": None}).rows

    def first(self, **query: object) -> Row | None:
        items = self.list(**{**query, "limit": 1, "offset": 0, "cursor": None}).items
        return items[0] if items else None

    def search(self, text: str, **query: object):
        return self.list(**{**query, "search": text})

    def count(self, **query: object) -> int:
        return select.count(self.files(), query.get("where"), query.get("search"))  # type: ignore[arg-type]

    def iterate(self, **query: object) -> Iterator[Row]:
        return select.iterate(self.files(), **query)  # type: ignore[arg-type]

    def facets(self, **query: object) -> dict:
        return aggregates.facets(self.files(), query.get("where"), query.get("search"))  # type: ignore[arg-type]

    def stats(self) -> dict:
        return aggregates.stats(self.files(), self.chunks())

    # --- backup ---

    def snapshot(self) -> DataFrame:
        """All records with their text and without bytes, trashed ones as well."""
        return select.public(self.files(), text=True)

    def backup(self, path: str) -> int:
        """Writes all records with their bytes, but for the columns that searches read, which are made anew
        when they are restored; their number."""
        names = [n for n in _NAMES if n not in SEARCH_COLUMNS]
        rows = self.files().join(C.assemble(self.chunks()), "content_id", "left").select(*names, F.col("data").alias("content"))
        rows.write.option("compression", "zstd").parquet(path)
        return self.spark.read.parquet(path).count()

    def restore_backup(self, path: str, replace: bool = False) -> int:
        """Adds the records of a backup, with hashes made anew; trashed ones are trashed again."""
        if replace:
            self.clear()
        rows = self.spark.read.parquet(path)
        raw = rows.select("id", "name", "mime", "kind", "tags", "folder", "favorite", "notes", "metadata", "text", "created_at", "updated_at", "width", "height", "duration_ms", F.coalesce("content", F.lit(b"").cast("binary")).alias("content"))
        n = self.ingest(raw)
        gone = self._of(rows.where("deleted_at > 0"))
        self._publish_rows(gone.withColumn("deleted_at", F.lit(now_ms())).withColumn("revision", F.col("revision") + 1), "delete")
        return n

    # --- feed ---

    def stream(self) -> DataFrame:
        return read_changes(self.spark, self._folder("changes"))

    def sync(self, checkpoint: str) -> None:
        """Tells listeners of change what other writers did since the checkpoint."""
        follow(self.stream(), lambda c: self.events.emit("change", c), self.source, checkpoint).awaitTermination()


#: What no record shows.
_HIDDEN = frozenset("name_lower notes_lower text_lower tags_lower meta_text tags_key text content_id chunk_count chunk_size".split())


def record(row: dict) -> dict:
    """A row as callers see it."""
    out = {k: v for k, v in row.items() if k not in _HIDDEN}
    return out | {"favorite": row["favorite"] == 1, "deleted": row["deleted_at"] > 0, "deleted_at": row["deleted_at"] or None, "metadata": json.loads(row["metadata"])}
