"""Binary flight recordings as a Spark data source: files are cut at their chunks, and each task decodes its chunks by itself.

``register(spark)``, then ``spark.read.format("flight_recording").option("part", ...).load(path)``. A chunk holds all that its events refer to:
the types they are of and the constants they name. So nothing is joined to resolve an event, and a recording of any length is the work of as
many tasks as it has chunks. A chunk that can't be read is a row of the part ``chunks`` with its error, and has no rows in the other parts.

Parts: ``events`` (one row an event), ``constants`` (pool entries, with references as keys), ``elements`` (the tree of type declarations),
``declarations`` (their digest, and in a task's first chunk that has it the declarations themselves), ``types`` (events by type), ``chunks``. ``decode`` does the same for chunks held in a binary column.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FRAME = "struct<method:string,java:boolean>"
SCHEMAS = {
    "events": f"artifact_id string, chunk_at long, at long, type string, label string, start_ns long, duration_ns long, thread string, stack array<{FRAME}>, fields map<string,string>",
    "constants": "artifact_id string, chunk_at long, type string, key long, fields map<string,string>",
    "elements": "artifact_id string, chunk_at long, position long, parent long, element string, attributes map<string,string>",
    "declarations": "artifact_id string, chunk_at long, digest string, declared binary",
    "types": "artifact_id string, chunk_at long, type string, events long",
    "chunks": "artifact_id string, chunk_at long, size long, start_ns long, duration_ns long, events long, error string",
}
_STRINGS = pa.map_(pa.string(), pa.string())
_ARROW = {
    "events": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("at", pa.int64()), ("type", pa.string()), ("label", pa.string()), ("start_ns", pa.int64()), ("duration_ns", pa.int64()), ("thread", pa.string()), ("stack", pa.list_(pa.struct([("method", pa.string()), ("java", pa.bool_())]))), ("fields", _STRINGS)]),
    "constants": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("type", pa.string()), ("key", pa.int64()), ("fields", _STRINGS)]),
    "elements": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("position", pa.int64()), ("parent", pa.int64()), ("element", pa.string()), ("attributes", _STRINGS)]),
    "declarations": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("digest", pa.string()), ("declared", pa.binary())]),
    "types": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("type", pa.string()), ("events", pa.int64())]),
    "chunks": pa.schema([("artifact_id", pa.string()), ("chunk_at", pa.int64()), ("size", pa.int64()), ("start_ns", pa.int64()), ("duration_ns", pa.int64()), ("events", pa.int64()), ("error", pa.string())]),
}

#: Fixed values of the format: the header of a chunk, and the types of its two kinds of events that describe it.
MAGIC, HEADER = b"FLR\0", struct.Struct(">4sHHqqqqqqqI")
METADATA, CONSTANTS = 0, 1
#: What an event field means that isn't only a value.
TICKS = {"NANOSECONDS": 1, "MICROSECONDS": 1_000, "MILLISECONDS": 1_000_000, "SECONDS": 1_000_000_000, "NANOSECONDS_SINCE_EPOCH": 1, "MILLISECONDS_SINCE_EPOCH": 1_000_000, "SECONDS_SINCE_EPOCH": 1_000_000_000}
#: Rows of one Arrow batch; references that are followed below a field.
ROWS, DEEPEST = 2000, 2


class Unreadable(ValueError):
    """A chunk that isn't what the format says."""


@dataclass
class Header:
    size: int
    constants_at: int
    metadata_at: int
    start_ns: int
    duration_ns: int
    start_ticks: int
    frequency: int


def header(data: bytes) -> Header:
    """The header at the start of a chunk."""
    if len(data) < HEADER.size:
        raise Unreadable("the file ends within a chunk's header")
    magic, major, minor, size, constants, metadata, start, duration, ticks, frequency, flags = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise Unreadable("no chunk begins here")
    if major not in (1, 2) or not flags & 1:
        raise Unreadable(f"version {major}.{minor} is not known")
    if size < HEADER.size or frequency <= 0:
        raise Unreadable("the chunk was not completed")
    return Header(size, constants, metadata, start, duration, ticks, frequency)


class Cursor:
    """Reads values from a chunk, one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        self.at += 1
        return self.data[self.at - 1]

    def varint(self) -> int:
        """A number in groups of seven bits, the ninth of which has eight; negative ones fill all of them."""
        data, at, value, shift = self.data, self.at, 0, 0
        while True:
            b = data[at]
            at += 1
            if shift == 56:
                value |= b << 56
                break
            value |= (b & 0x7F) << shift
            if b < 0x80:
                break
            shift += 7
        self.at = at
        return value - (1 << 64) if value >> 63 else value

    def unpack(self, form: struct.Struct) -> float:
        self.at += form.size
        return form.unpack_from(self.data, self.at - form.size)[0]

    def take(self, size: int) -> bytes:
        if size < 0 or self.at + size > len(self.data):
            raise Unreadable("a text reaches beyond its chunk")
        self.at += size
        return self.data[self.at - size : self.at]

    def text(self) -> str | Ref | None:
        kind = self.byte()
        if kind == 0:
            return None
        if kind == 1:
            return ""
        if kind == 2:
            return Ref("java.lang.String", self.varint())
        if kind == 3:
            return self.take(self.varint()).decode("utf-8", "replace")
        if kind == 4:
            return "".join(chr(self.varint()) for _ in range(self.varint())).encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        if kind == 5:
            return self.take(self.varint()).decode("latin-1")
        raise Unreadable(f"text encoding {kind} is not known")


@dataclass(frozen=True)
class Ref:
    """A key of a pool."""

    type: str
    key: int


@dataclass
class Element:
    """A node of the declarations, at its depth-first position."""

    name: str
    attributes: dict[str, str]
    position: int
    parent: int | None
    children: list[Element] = field(default_factory=list)

    def of(self, name: str) -> list[Element]:
        return [c for c in self.children if c.name == name]


@dataclass
class Field:
    name: str
    type: Type
    read: Callable[[Cursor], object]
    annotations: dict[str, dict[str, str]]


@dataclass
class Type:
    name: str
    is_event: bool
    fields: list[Field] = field(default_factory=list)
    label: str | None = None


_FLOAT, _DOUBLE = struct.Struct(">f"), struct.Struct(">d")
#: How the primitive types are written.
_PRIMITIVES: dict[str, Callable[[Cursor], object]] = {
    "boolean": lambda c: bool(c.byte()), "byte": lambda c: c.byte() - (c.data[c.at - 1] >> 7 << 8), "char": Cursor.varint, "short": Cursor.varint, "int": Cursor.varint, "long": Cursor.varint,
    "float": lambda c: c.unpack(_FLOAT), "double": lambda c: c.unpack(_DOUBLE), "java.lang.String": Cursor.text,
}


def _narrow(value: int, bits: int) -> int:
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


_PRIMITIVES["short"] = lambda c: _narrow(c.varint(), 16)
_PRIMITIVES["int"] = lambda c: _narrow(c.varint(), 32)


def _size(cursor: Cursor, end: int) -> int:
    size = cursor.varint()
    if size <= 0 or size > end:
        raise Unreadable(f"an event of {size} bytes can't be")
    return size


class Declarations:
    """The types that a chunk declares, from the body of the event that does."""

    def __init__(self, body: bytes):
        self.elements: list[Element] = []
        self.types: dict[int, Type] = {}
        self._declare(Cursor(body))

    def _declare(self, cursor: Cursor) -> None:
        texts = [cursor.text() for _ in range(cursor.varint())]
        work: list[tuple[int | None, int]] = [(None, 1)]
        while work:  # depth first: an element, then what is below it
            parent, left = work.pop()
            if not left:
                continue
            work.append((parent, left - 1))
            name = texts[cursor.varint()]
            attributes = {texts[cursor.varint()]: texts[cursor.varint()] for _ in range(cursor.varint())}
            element = Element(name, attributes, len(self.elements), parent)
            self.elements.append(element)
            if parent is not None:
                self.elements[parent].children.append(element)
            work.append((element.position, cursor.varint()))
        classes = {int(e.attributes["id"]): e for e in self.elements if e.name == "class"}
        self.types = {key: Type(e.attributes["name"], e.attributes.get("superType") == "jdk.jfr.Event") for key, e in classes.items()}
        for key, element in classes.items():
            notes = self._annotations(element)
            self.types[key].label = notes.get("jdk.jfr.Label", {}).get("value")
            for f in element.of("field"):
                kind = self.types.get(int(f.attributes["class"]))
                if kind is None:
                    raise Unreadable(f"field {f.attributes.get('name')} is of no declared type")
                one = _reader(kind, f.attributes.get("constantPool") == "true")
                many = f.attributes.get("dimension", "0") != "0"
                self.types[key].fields.append(Field(f.attributes["name"], kind, _array(one) if many else one, self._annotations(f)))

    def _annotations(self, element: Element) -> dict[str, dict[str, str]]:
        found = {}
        for a in element.of("annotation"):
            kind = self.types.get(int(a.attributes["class"]))
            if kind:
                found[kind.name] = a.attributes
        return found


#: Chunks of one JVM declare the same types, so the last few declarations serve most chunks of a task.
_declarations = lru_cache(maxsize=32)(Declarations)


def declaring(data: bytes, head: Header) -> bytes:
    """The body of the event that declares a chunk's types."""
    cursor = Cursor(data, head.metadata_at)
    end = head.metadata_at + _size(cursor, head.size)
    if cursor.varint() != METADATA:
        raise Unreadable("no declarations where the header says")
    for _ in range(3):  # start, duration, number of the declaration
        cursor.varint()
    return data[cursor.at : end]


def _reader(kind: Type, pooled: bool) -> Callable[[Cursor], object]:
    if pooled:
        return lambda c: Ref(kind.name, c.varint())
    if kind.name in _PRIMITIVES:
        return _PRIMITIVES[kind.name]
    return lambda c: {f.name: f.read(c) for f in kind.fields}


def _array(one: Callable[[Cursor], object]) -> Callable[[Cursor], object]:
    return lambda c: [one(c) for _ in range(c.varint())]


class Chunk:
    """One chunk with its declarations; constants are read when something asks for them."""

    def __init__(self, data: bytes):
        self.head = header(data)
        if len(data) < self.head.size:
            raise Unreadable("the file ends within a chunk")
        self.data = data[: self.head.size]
        self.declared = declaring(self.data, self.head)
        self.types = _declarations(self.declared).types
        self.pools: dict[tuple[str, int], object] = {}
        self.shown: dict[tuple, object] = {}

    def read_constants(self) -> None:
        """All pools of the chunk; each event that holds some names the one before it."""
        at = self.head.constants_at
        seen: set[int] = set()
        while at and at not in seen:
            seen.add(at)
            cursor = Cursor(self.data, at)
            _size(cursor, self.head.size)
            if cursor.varint() != CONSTANTS:
                raise Unreadable("no constants where the header says")
            cursor.varint(), cursor.varint()  # start, duration
            before = cursor.varint()
            cursor.byte()
            for _ in range(cursor.varint()):
                kind = self.types.get(cursor.varint())
                if kind is None:
                    raise Unreadable("constants of no declared type")
                read = _reader(kind, False)
                for _ in range(cursor.varint()):
                    key = cursor.varint()
                    self.pools.setdefault((kind.name, key), read(cursor))
            at = at + before if before else 0

    def events(self) -> Iterator[tuple[int, Type, dict[str, object]]]:
        at, end = HEADER.size, self.head.size
        while at < end:
            cursor = Cursor(self.data, at)
            size = _size(cursor, end - at)
            kind = self.types.get(number) if (number := cursor.varint()) not in (METADATA, CONSTANTS) else None
            if kind is not None:
                yield at, kind, {f.name: f.read(cursor) for f in kind.fields}
            elif number not in (METADATA, CONSTANTS):
                raise Unreadable(f"an event of type {number}, which is not declared")
            at += size

    def nanos(self, ticks: int) -> int:
        return int(ticks / (self.head.frequency / 1_000_000_000))

    def instant(self, ticks: int) -> int:
        return self.head.start_ns + self.nanos(ticks - self.head.start_ticks)

    def value(self, ref: object) -> object:
        """What a reference stands for."""
        while isinstance(ref, Ref):
            ref = self.pools.get((ref.type, ref.key))
        return ref

    def name(self, value: object) -> str | None:
        """The name by which a thread, class, method or symbol is known; a text itself; of other objects their only part, if it is a text."""
        key = (value.type, value.key) if isinstance(value, Ref) else None
        if key in self.shown:
            return self.shown[key]
        found = self._name(value.type if isinstance(value, Ref) else "", self.value(value))
        if key:
            self.shown[key] = found
        return found

    def _name(self, kind: str, value: object) -> str | None:
        if isinstance(value, str):
            return value.strip() or None
        if not isinstance(value, dict):
            return None
        if kind == "java.lang.Thread":
            return next((n for n in (self.name(value.get(part)) for part in ("javaName", "osName", "name")) if n), None)
        if kind == "java.lang.Class":
            found = self.name(value.get("name"))
            return found.replace("/", ".") if found else None
        if kind == "jdk.types.Method":
            owner, own = self.name(value.get("type")), self.name(value.get("name"))
            return f"{owner}.{own}" if owner and own else None
        if len(value) == 1:
            return self.name(next(iter(value.values())))
        return self.name(value["name"]) if isinstance(value.get("name"), (str, Ref)) else None

    def flat(self, fields: list[Field], values: dict[str, object], depth: int = 0, before: str = "") -> Iterator[tuple[str, str]]:
        """Names and texts of fields; objects that have no name are opened, those too deep are their keys, times are nanoseconds."""
        for f in fields:
            value, name = values[f.name], before + f.name
            if value is None:
                continue
            if isinstance(value, bool):
                yield name, "true" if value else "false"
            elif isinstance(value, (int, float)):
                yield name, str(self._time(f, value))
            elif isinstance(value, list):
                yield name, ",".join(str(self.name(v) if isinstance(v, (str, dict, Ref)) else v) for v in value)
            elif (text := self.name(value)) is not None:
                yield name, text
            elif isinstance(opened := self.value(value), dict):
                if isinstance(value, Ref):
                    yield name, str(value.key)
                if depth < DEEPEST:
                    yield from self.flat(f.type.fields, opened, depth + 1, name + ".")

    def _time(self, f: Field, value: float) -> float:
        note = f.annotations.get("jdk.jfr.Timestamp") or f.annotations.get("jdk.jfr.Timespan")
        if not note or isinstance(value, float):
            return value
        unit = note.get("value", "TICKS" if "jdk.jfr.Timestamp" in f.annotations else "NANOSECONDS")
        if unit == "TICKS":
            return self.instant(value) if "jdk.jfr.Timestamp" in f.annotations else self.nanos(value)
        return value * TICKS.get(unit, 1)

    def stack(self, ref: object) -> list[dict] | None:
        key = ("stack", ref.key) if isinstance(ref, Ref) else None
        if key in self.shown:
            return self.shown[key]
        trace = self.value(ref)
        frames = trace.get("frames") if isinstance(trace, dict) else None
        found = [{"method": m, "java": f.get("javaFrame", True)} for f in map(self.value, frames or []) if (m := self.name(f.get("method")))]
        if key:
            self.shown[key] = found
        return found

    def event_row(self, at: int, kind: Type, values: dict[str, object]) -> tuple:
        """at, type, label, start_ns, duration_ns, thread, stack, fields."""
        start, duration = values.get("startTime"), values.get("duration")
        thread = next((n for n in (self.name(values.get(part)) for part in ("eventThread", "sampledThread", "thread")) if n), None)
        rest = [f for f in kind.fields if f.name not in ("startTime", "duration", "eventThread", "stackTrace")]
        trace = values.get("stackTrace")
        return at, kind.name, kind.label, None if start is None else self.instant(start), None if duration is None else self.nanos(duration), thread, None if trace is None else self.stack(trace), list(self.flat(rest, values))


def _elements(declared: bytes) -> Iterator[tuple]:
    for e in _declarations(declared).elements:
        yield e.position, e.parent, e.name, list(e.attributes.items())


def _rows(part: str, data: bytes, kinds: frozenset[str] | None = None) -> Iterator[tuple]:
    """The rows of one part of one chunk, without the chunk's own columns."""
    chunk = Chunk(data)
    if part == "elements":
        yield from _elements(chunk.declared)
        return
    if part == "declarations":
        yield sha256(chunk.declared).hexdigest(), chunk.declared
        return
    chunk.read_constants()
    if part == "events":
        for at, kind, values in chunk.events():
            yield chunk.event_row(at, kind, values)
    elif part == "constants":
        fields = {t.name: t.fields for t in chunk.types.values()}
        for (kind, key), value in chunk.pools.items():
            if kinds and kind not in kinds:
                continue
            shown = {"": value} if not isinstance(value, dict) else value
            yield kind, key, list(chunk.flat(fields[kind], shown, depth=DEEPEST)) if isinstance(value, dict) else [("", str(value))]
    elif part == "types":
        yield from Counter(kind.name for _, kind, _ in chunk.events()).items()
    else:
        yield chunk.head.size, chunk.head.start_ns, chunk.head.duration_ns, sum(1 for _ in chunk.events()), None


def _checked(part: str, data: bytes, kinds: frozenset[str] | None = None) -> list[tuple]:
    """All rows of a chunk, or, for a chunk that can't be read to its end, none (in ``chunks``: its error)."""
    try:
        return list(_rows(part, data, kinds))
    except (Unreadable, IndexError, KeyError, struct.error, UnicodeError, ValueError, OverflowError) as error:
        return [(len(data), None, None, 0, f"{type(error).__name__}: {error}")] if part == "chunks" else []


def _batches(part: str, chunks: Iterator[tuple[str, int, bytes]], kinds: frozenset[str] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of several chunks share a batch. Of equal declarations only the first of a task is handed on whole."""
    schema = _ARROW[part]
    held: list[tuple] = []
    told: set[str] = set()

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)

    for artifact, at, data in chunks:
        rows = _checked(part, data, kinds)
        if part == "declarations":
            rows = [(digest, None if digest in told else declared) for digest, declared in rows]
            told.update(digest for digest, _ in rows)
        for row in rows:
            held.append((artifact, at, *row))
            if len(held) >= ROWS:
                yield batch(held)
                held = []
    if held:
        yield batch(held)


def chunk_bounds(size: int, read: Callable[[int, int], bytes]) -> Iterator[tuple[int, int]]:
    """Offset and size of each chunk of a file, by the headers alone; from a header that can't be read on, the rest of the file is one."""
    at = 0
    while at < size:
        try:
            length = min(header(read(at, HEADER.size)).size, size - at)
        except Unreadable:
            length = size - at
        yield at, length
        at += length


def decode(recordings: DataFrame, part: str = "events", kinds: tuple[str, ...] = ()) -> DataFrame:
    """A part of recordings that a column holds: ``recordings`` has artifact_id, chunk_at and content (binary, whole chunks).

    ``kinds`` names the types of constants that are wanted; none means all.
    """
    wanted = frozenset(kinds)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple[str, int, bytes]]:
            for batch in batches:
                for artifact, first, content in zip(*(batch.column(k) for k in range(3)), strict=True):
                    data = content.as_py() or b""
                    for at, length in chunk_bounds(len(data), lambda at, n, data=data: data[at : at + n]):
                        yield artifact.as_py(), first.as_py() + at, data[at : at + length]

        yield from _batches(part, chunks(), wanted)

    recordings.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64m")
    return recordings.selectExpr("artifact_id", "CAST(chunk_at AS LONG) AS chunk_at", "content").mapInArrow(work, SCHEMAS[part])


def elements_of(declarations: DataFrame) -> DataFrame:
    """The part ``elements`` of declarations themselves: ``declarations`` has artifact_id, chunk_at and declared (binary, as the part ``declarations``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _ARROW["elements"]
        for batch in batches:
            for artifact, at, declared in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows = [(artifact, at, *row) for row in _elements(declared)]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return declarations.selectExpr("artifact_id", "CAST(chunk_at AS LONG) AS chunk_at", "declared").mapInArrow(work, SCHEMAS["elements"])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Task(InputPartition):
    def __init__(self, spans: list[tuple[str, int, int]]):
        super().__init__(0)
        self.spans = spans


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], part: str):
        self.path, self.part = options["path"], part
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", 16 << 20)))

    def partitions(self) -> list[InputPartition]:
        """Chunks of files in order; small ones share a task up to ``taskBytes``. Only headers are read here, of many files at once."""
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.path.endswith(".jfr")]

        def bounds(f: fs.FileInfo) -> list[tuple[str, int, int]]:
            with store.open_input_file(f.path) as file:
                return [(f.path, at, n) for at, n in chunk_bounds(f.size, lambda at, n: file.read_at(min(n, f.size - at), at))]

        with ThreadPoolExecutor(32) as pool:
            spans = [span for many in pool.map(bounds, sorted(found, key=lambda f: f.path)) for span in many]
        tasks: list[list[tuple[str, int, int]]] = []
        held = self.task_bytes
        for span in spans:
            if not tasks or held + span[2] > self.task_bytes:
                tasks.append([])
                held = 0
            tasks[-1].append(span)
            held += span[2]
        return [_Task(spans) for spans in tasks] or [_Task([])]

    def read(self, partition: _Task) -> Iterator[pa.RecordBatch]:
        store, _ = _open(self.path)

        def chunks() -> Iterator[tuple[str, int, bytes]]:
            for path, at, length in partition.spans:
                with store.open_input_file(path) as file:
                    yield path, at, file.read_at(length, at)

        yield from _batches(self.part, chunks())


class FlightRecordings(DataSource):
    """Options: path (a file or a folder), part, taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "flight_recording"

    def _part(self) -> str:
        part = self.options.get("part", "events")
        if part not in SCHEMAS:
            raise ValueError(f"part must be one of {', '.join(SCHEMAS)}")
        return part

    def schema(self) -> str:
        return SCHEMAS[self._part()]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(dict(self.options), self._part())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FlightRecordings)


def read(spark: SparkSession, path: str, part: str = "events") -> DataFrame:
    """A part of all recordings under ``path``, on any store that Arrow opens."""
    register(spark)
    return spark.read.format(FlightRecordings.name()).option("part", part).load(path)
