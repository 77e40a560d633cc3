"""Packs: files that hold many objects, whole or as deltas, read and written as bytes.

Where an entry ends is known only once it is inflated, so a pack is read front to back by one task, which
holds its objects until their deltas are worked out.  Tasks work on packs side by side;
packs that :func:`write_packs` makes hold about ``pack_bytes`` of objects each, however many objects there are.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the format: codes of entries, and the longest copy and insert of a delta.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_ID = 6, 7
MAX_COPY, MAX_INSERT = 0xFFFF, 0x7F

CODES = {kind: code for code, kind in KINDS.items()}
#: Bytes that must agree for a delta to copy them, and the longest chain of deltas that is written.
BLOCK, MAX_CHAIN = 16, 50
MAX_OBJECT = 100 << 20
OBJECTS = "pack string, offset long, kind string, oid string, size long, depth int, base string, content binary"


class BadPack(ValueError):
    """The bytes are no whole pack."""


def number(data: bytes, at: int) -> tuple[int, int]:
    """A number in groups of seven bits, the lowest first, and where it ends."""
    value, shift = 0, 0
    while True:
        if at >= len(data) or shift > 63:
            raise BadPack("a number is cut short")
        value |= (data[at] & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if data[at - 1] < 0x80:
            return value, at


def number_bytes(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    return bytes([*out, value])


def head_bytes(code: int, size: int) -> bytes:
    """An entry's code and size: four bits of the size beside the code, then groups of seven."""
    low = code << 4 | size & 0xF
    return bytes([low]) if size < 16 else bytes([low | 0x80]) + number_bytes(size >> 4)


def back_bytes(distance: int) -> bytes:
    """How far back a base lies: groups of seven bits, the highest first, where each further group counts from one."""
    out = [distance & 0x7F]
    while distance := distance >> 7:
        distance -= 1
        out.append(distance & 0x7F | 0x80)
    return bytes(reversed(out))


def back(data: bytes, at: int) -> tuple[int, int]:
    value = -1
    while True:
        if at >= len(data):
            raise BadPack("a distance is cut short")
        value, at = (value + 1) << 7 | data[at] & 0x7F, at + 1
        if data[at - 1] < 0x80:
            return value, at


def inflate(data: bytes, at: int, size: int) -> tuple[bytes, int]:
    """``size`` bytes inflated from ``at`` on, and where their stream ends; reads little beyond it."""
    stream, out, step = zlib.decompressobj(), bytearray(), size + size // 1000 + 64
    while not stream.eof:
        if at >= len(data):
            raise BadPack("an entry is cut short")
        part = data[at : at + step]
        try:
            out += stream.decompress(part, size + 1 - len(out))
            while stream.unconsumed_tail and len(out) <= size:
                out += stream.decompress(stream.unconsumed_tail, size + 1 - len(out))
        except zlib.error as wrong:
            raise BadPack(f"an entry does not inflate: {wrong}") from None
        if len(out) > size:
            raise BadPack("an entry is longer than it says")
        at += len(part) - len(stream.unused_data)
    if len(out) != size:
        raise BadPack("an entry is shorter than it says")
    return bytes(out), at


def apply_delta(base: bytes, delta: bytes, max_object: int = MAX_OBJECT) -> bytes:
    """The object that a delta makes of its base."""
    of, at = number(delta, 0)
    size, at = number(delta, at)
    if of != len(base):
        raise BadPack("a delta is of another base")
    if size > max_object:
        raise BadPack(f"an object of {size} bytes is over the limit of {max_object}")
    out = bytearray()
    while at < len(delta):
        order, at = delta[at], at + 1
        if order & 0x80:  # a copy: bits tell which bytes of start (four) and length (three) follow
            fields = []
            for bits in (range(4), range(4, 7)):
                value = 0
                for place, bit in enumerate(bits):
                    if order >> bit & 1:
                        if at >= len(delta):
                            raise BadPack("a delta is cut short")
                        value, at = value | delta[at] << 8 * place, at + 1
                fields.append(value)
            start, length = fields[0], fields[1] or 0x10000
            if start + length > len(base):
                raise BadPack("a delta copies from beyond its base")
            out += base[start : start + length]
        elif order:
            if at + order > len(delta):
                raise BadPack("a delta is cut short")
            out += delta[at : at + order]
            at += order
        else:
            raise BadPack("a delta has an unknown order")
        if len(out) > size:
            break
    if len(out) != size:
        raise BadPack("a delta makes another size than it says")
    return bytes(out)


def delta_of(base: bytes, target: bytes) -> bytes:
    """A delta from ``base`` to ``target``: blocks met in the base are copied as far as they agree, the rest is inserted."""
    out = bytearray(number_bytes(len(base)) + number_bytes(len(target)))
    blocks: dict[bytes, int] = {}
    for k in range(0, len(base) - BLOCK + 1, BLOCK):
        blocks.setdefault(base[k : k + BLOCK], k)

    def insert(a: int, b: int) -> None:
        for k in range(a, b, MAX_INSERT):
            part = target[k : min(b, k + MAX_INSERT)]
            out.append(len(part))
            out.extend(part)

    def copy(start: int, length: int) -> None:
        while length:
            part = min(length, MAX_COPY)
            order, tail = 0x80, bytearray()
            for bit, byte in [*((k, start >> 8 * k & 0xFF) for k in range(4)), *((4 + k, part >> 8 * k & 0xFF) for k in range(2))]:
                if byte:
                    order |= 1 << bit
                    tail.append(byte)
            out.append(order)
            out.extend(tail)
            start, length = start + part, length - part

    done = at = 0  # all before `done` is written, `at` is looked up
    while at + BLOCK <= len(target):
        start = blocks.get(target[at : at + BLOCK])
        if start is None:
            at += 1
            continue
        length = BLOCK
        while step := next((n for n in (4096, 256, BLOCK, 1) if at + length + n <= len(target) and target[at + length : at + length + n] == base[start + length : start + length + n]), 0):
            length += step
        while at > done and start and target[at - 1] == base[start - 1]:
            at, start, length = at - 1, start - 1, length + 1
        insert(done, at)
        copy(start, length)
        done = at = at + length
    insert(done, len(target))
    return bytes(out)


@dataclass
class Entry:
    """An entry as it lies in a pack; ``base``: an offset, an id in hex, or nothing."""

    offset: int
    code: int
    base: int | str | None
    content: bytes


def entries(pack: bytes, hash_name: str = "sha1", max_object: int = MAX_OBJECT) -> Iterator[Entry]:
    """The entries of a pack in order; its header, sizes and closing hash are checked."""
    width = hashlib.new(hash_name).digest_size
    if len(pack) < 12 + width or pack[:4] != b"PACK" or int.from_bytes(pack[4:8]) not in (2, 3):
        raise BadPack("not a pack of version 2 or 3")
    if hashlib.new(hash_name, memoryview(pack)[:-width]).digest() != pack[-width:]:
        raise BadPack("the closing hash is of other bytes")
    at, end = 12, len(pack) - width
    for _ in range(int.from_bytes(pack[8:12])):
        if at >= end:
            raise BadPack("entries are missing")
        offset, code, size = at, pack[at] >> 4 & 7, pack[at] & 0xF
        at += 1
        if pack[offset] & 0x80:
            more, at = number(pack, at)
            size |= more << 4
        base: int | str | None = None
        if code == BY_OFFSET:
            far, at = back(pack, at)
            base = offset - far
        elif code == BY_ID:
            base, at = pack[at : at + width].hex(), at + width
        elif code not in KINDS:
            raise BadPack(f"an entry has the unknown code {code}")
        if size > max_object:
            raise BadPack(f"an object of {size} bytes is over the limit of {max_object}")
        content, at = inflate(pack, at, size)
        yield Entry(offset, code, base, content)
    if at != end:
        raise BadPack("bytes follow the last entry")


def object_id(kind: str, content: bytes, hash_name: str = "sha1") -> str:
    return hashlib.new(hash_name, b"%s %d\0" % (kind.encode(), len(content)) + content).hexdigest()


def objects(pack: bytes, hash_name: str = "sha1", max_object: int = MAX_OBJECT) -> Iterator[tuple[int, str, str, int, int, str | None, bytes]]:
    """(offset, kind, oid, size, depth, base, content) of every object, a base before what builds on it.

    ``depth`` counts the deltas behind an object and ``base`` is the id of the nearest.  A base may come
    anywhere in the pack; one that is not in it is an error.
    """
    waiting: dict[int | str, list[Entry]] = {}
    whole = []
    for entry in entries(pack, hash_name, max_object):
        if entry.base is None:
            whole.append(entry)
        else:
            waiting.setdefault(entry.base, []).append(entry)
    for root in whole:
        ready = [(root, KINDS[root.code], root.content, 0, None)]
        while ready:
            entry, kind, content, depth, base = ready.pop()
            oid = object_id(kind, content, hash_name)
            yield entry.offset, kind, oid, len(content), depth, base, content
            for child in [*waiting.pop(entry.offset, ()), *waiting.pop(oid, ())]:
                ready.append((child, kind, apply_delta(content, child.content, max_object), depth + 1, oid))
    if waiting:
        raise BadPack(f"{sum(map(len, waiting.values()))} deltas have no base in the pack")


def pack_of(rows: list[tuple[str, bytes]], hash_name: str = "sha1") -> bytes:
    """A pack of (kind, content), in order; an object is a delta of the one before if that halves it."""
    out = bytearray(b"PACK" + (2).to_bytes(4) + len(rows).to_bytes(4))
    last: tuple[str, bytes, int, int] | None = None  # kind, content, offset, length of its chain
    for kind, content in rows:
        offset, chain = len(out), 0
        delta = delta_of(last[1], content) if last and last[0] == kind and last[3] < MAX_CHAIN else None
        if delta is not None and 2 * len(delta) < len(content):
            chain = last[3] + 1
            out += head_bytes(BY_OFFSET, len(delta)) + back_bytes(offset - last[2]) + zlib.compress(delta)
        else:
            out += head_bytes(CODES[kind], len(content)) + zlib.compress(content)
        last = kind, content, offset, chain
    return bytes(out) + hashlib.new(hash_name, out).digest()


def pack_files(spark: SparkSession, path: str) -> DataFrame:
    """(pack, content) of the pack files at a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pack").load(path).select(F.col("path").alias("pack"), "content")


def read_packs(packs: DataFrame, hash_name: str = "sha1", max_object: int = MAX_OBJECT, batch_bytes: int = 32 << 20) -> DataFrame:
    """The objects of packs (pack, content), as :func:`objects` says; a pack that is not whole is an error, null content one without rows."""
    schema = pa.schema([("pack", pa.string()), ("offset", pa.int64()), ("kind", pa.string()), ("oid", pa.string()), ("size", pa.int64()), ("depth", pa.int32()), ("base", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("pack"), batch.column("content"), strict=True):
                rows, held = [], 0
                for found in objects(content.as_py(), hash_name, max_object) if content.is_valid else ():
                    rows.append((name.as_py(), *found))
                    held += found[3]
                    if held >= batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return packs.select(F.col("pack").cast("string").alias("pack"), "content").mapInArrow(run, OBJECTS)


def write_packs(rows: DataFrame, pack_bytes: int = 64 << 20, hash_name: str = "sha1") -> DataFrame:
    """(pack, objects, content): packs of the objects (oid, kind, content), each object once.

    Objects are dealt by their ids into as many packs as their bytes ask for.  In a pack they come by kind and then from
    the largest, as objects of like size make the shortest deltas.
    """
    rows = rows.select("oid", "kind", F.col("content").cast("binary").alias("content")).where("content is not null")
    total = rows.agg(F.sum(F.octet_length("content"))).first()[0] or 0
    dealt = rows.dropDuplicates(["oid"]).withColumn("pack", F.pmod(F.xxhash64("oid"), F.lit(total // pack_bytes + 1)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        held = sorted(zip(table.column("kind").to_pylist(), table.column("content").to_pylist(), strict=True), key=lambda r: (CODES[r[0]], -len(r[1]), r[1]))
        return pa.table({"pack": pa.array([table.column("pack")[0].as_py()], pa.int64()), "objects": pa.array([len(held)], pa.int64()), "content": pa.array([pack_of(held, hash_name)], pa.binary())})

    return dealt.select("pack", "kind", "content").groupBy("pack").applyInArrow(run, "pack long, objects long, content binary")
