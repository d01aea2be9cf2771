"""Writes binary flight recordings: one chunk from declarations, constants and events. Renders test data; a JVM writes its own."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from heapstone.sources.recordings import CONSTANTS, HEADER, MAGIC, METADATA

Annotations = dict[str, dict[str, str]]


@dataclass
class Declared:
    """A type: its fields as (name, type, whether they are keys of a pool, whether they are arrays, annotations)."""

    name: str
    fields: list[tuple[str, str, bool, bool, Annotations]]
    above: str | None = None
    annotations: Annotations = field(default_factory=dict)


def varint(value: int) -> bytes:
    value &= (1 << 64) - 1
    out = bytearray()
    for _ in range(8):
        if value < 0x80:
            break
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def text(value: str | None) -> bytes:
    if value is None:
        return b"\0"
    data = value.encode()
    return b"\x03" + varint(len(data)) + data if data else b"\x01"


def sized(body: bytes) -> bytes:
    """An event with its size before it, in four bytes of any size."""
    size = len(body) + 4
    return bytes([size & 0x7F | 0x80, size >> 7 & 0x7F | 0x80, size >> 14 & 0x7F | 0x80, size >> 21]) + body


_PRIMITIVE = {
    "boolean": lambda v: bytes([bool(v)]), "byte": lambda v: bytes([v & 0xFF]), "char": varint, "short": varint, "int": varint, "long": varint,
    "float": lambda v: struct.pack(">f", v), "double": lambda v: struct.pack(">d", v), "java.lang.String": text,
}


class Declarations:
    """Types with their numbers and the event that declares them; chunks of the same types can share it."""

    def __init__(self, types: list[Declared]):
        self.types = {t.name: t for t in types}
        used = [*self.types, *(a for t in types for a in t.annotations), *(a for t in types for f in t.fields for a in f[4]), *(f[1] for t in types for f in t.fields)]
        self.ids = {name: 10 + n for n, name in enumerate(dict.fromkeys(used))}
        self.event = self._event()

    def _event(self) -> bytes:
        texts: dict[str, int] = {}
        at = lambda t: texts.setdefault(t, len(texts))

        def element(name: str, attributes: dict[str, str], children: list[bytes]) -> bytes:
            return varint(at(name)) + varint(len(attributes)) + b"".join(varint(at(k)) + varint(at(v)) for k, v in attributes.items()) + varint(len(children)) + b"".join(children)

        def notes(annotations: Annotations) -> list[bytes]:
            return [element("annotation", {"class": str(self.ids[name]), **values}, []) for name, values in annotations.items()]

        classes = []
        for name, number in self.ids.items():
            declared = self.types.get(name, Declared(name, []))
            fields = [element("field", {"name": f, "class": str(self.ids[kind])} | ({"constantPool": "true"} if pooled else {}) | ({"dimension": "1"} if many else {}), notes(annotations)) for f, kind, pooled, many, annotations in declared.fields]
            classes.append(element("class", {"name": name, "id": str(number)} | ({"superType": declared.above} if declared.above else {}), fields + notes(declared.annotations)))
        tree = element("root", {}, [element("metadata", {}, classes), element("region", {"locale": "en_US", "gmtOffset": "0"}, [])])
        return sized(varint(METADATA) + varint(0) + varint(0) + varint(1) + varint(len(texts)) + b"".join(text(t) for t in texts) + tree)


class Chunk:
    def __init__(self, types: list[Declared] | Declarations, start_ns: int):
        self.declared = types if isinstance(types, Declarations) else Declarations(types)
        self.types, self.ids = self.declared.types, self.declared.ids
        self.start_ns, self.last_ns = start_ns, start_ns
        self.body, self.pools = bytearray(), {}

    def constant(self, kind: str, key: int, **values: object) -> int:
        self.pools.setdefault(kind, {})[key] = values
        return key

    def _value(self, kind: str, value: object) -> bytes:
        if kind in _PRIMITIVE:
            return _PRIMITIVE[kind](value)
        return b"".join(self._field(f, value[f[0]]) for f in self.types[kind].fields)

    def _field(self, declared: tuple, value: object) -> bytes:
        _, kind, pooled, many, _ = declared
        one = (lambda v: varint(v)) if pooled else (lambda v: self._value(kind, v))
        return varint(len(value)) + b"".join(map(one, value)) if many else one(value)

    def event(self, kind: str, **values: object) -> None:
        """``startTime`` is in nanoseconds of the epoch; ticks are nanoseconds from the chunk's start."""
        values["startTime"] -= self.start_ns
        self.last_ns = max(self.last_ns, self.start_ns + values["startTime"])
        self.body += sized(varint(self.ids[kind]) + b"".join(self._field(f, values[f[0]]) for f in self.types[kind].fields))

    def _constants(self, kinds: list[str], before: int) -> bytes:
        out = varint(CONSTANTS) + varint(0) + varint(0) + varint(before) + b"\0" + varint(len(kinds))
        for kind in kinds:
            out += varint(self.ids[kind]) + varint(len(self.pools[kind]))
            out += b"".join(varint(key) + self._value(kind, values) for key, values in self.pools[kind].items())
        return sized(out)

    def bytes(self) -> bytes:
        """Events, then the constants in two parts of which the later names the earlier, then the declarations."""
        kinds, at = list(self.pools), HEADER.size + len(self.body)
        first = self._constants(kinds[: len(kinds) // 2], 0)
        second = self._constants(kinds[len(kinds) // 2 :], -len(first))
        metadata = self.declared.event
        total = at + len(first) + len(second) + len(metadata)
        head = HEADER.pack(MAGIC, 2, 1, total, at + len(first), at + len(first) + len(second), self.start_ns, self.last_ns - self.start_ns, 0, 1_000_000_000, 1)
        return head + bytes(self.body) + first + second + metadata
