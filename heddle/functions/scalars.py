"""Scalar rules of the model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def object_id(kind: str, content: Column, bits: int = 160) -> Column:
    """Hash of the kind, the byte length, NUL and the bytes."""
    body = F.concat(F.lit(f"{kind} ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit(b"\0"), content.cast("binary"))
    return F.sha1(body) if bits == 160 else F.sha2(body, bits)


def blob_id(content: Column) -> Column:
    return object_id("blob", content)


def identity(line: Column) -> Column:
    """Name, email, seconds and zone offset of ``Name <mail> seconds zone``; a missing date or zone leaves both 0."""
    rest = F.regexp_extract(line, r"^.*>([^>]*)$", 1)
    date, zone = F.regexp_extract(rest, r"^ *(-?\d+) +[+-]\d{4}", 1), F.regexp_extract(rest, r"^ *-?\d+ +([+-]\d{4})", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    offset = sign * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60)
    return F.struct(
        F.rtrim(F.substring_index(line, "<", 1)).alias("name"),
        F.regexp_extract(line, r"^[^<]*<([^>]*)>", 1).alias("email"),
        F.coalesce(date.try_cast("long"), F.lit(0)).alias("seconds"),
        F.coalesce(offset, F.lit(0)).alias("offset_seconds"),
    )


def commit_fields(content: Column) -> Column:
    """Tree, parents, author, committer, summary and body of a commit's text."""
    head = F.substring_index(content, "\n\n", 1)
    blank = F.instr(content, "\n\n")
    message = F.when(blank > 0, F.substring(content, blank + 2, F.length(content))).otherwise("")
    line = F.instr(message, "\n")
    rest = F.when(line > 0, F.substring(message, line + 1, F.length(message))).otherwise("")
    return F.struct(
        F.regexp_extract(head, r"(?m)^tree ([0-9a-f]+)$", 1).alias("tree"),
        F.regexp_extract_all(head, F.lit(r"(?m)^parent ([0-9a-f]+)$"), F.lit(1)).alias("parents"),
        identity(F.regexp_extract(head, r"(?m)^author (.*)$", 1)).alias("author"),
        identity(F.regexp_extract(head, r"(?m)^committer (.*)$", 1)).alias("committer"),
        F.substring_index(message, "\n", 1).alias("summary"),
        F.when(rest.startswith("\n"), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest).alias("body"),
    )


def tag_target(content: Column) -> Column:
    return F.regexp_extract(F.substring_index(content, "\n", 1), r"^object ([0-9a-f]+)$", 1)


def mode_kind(mode: Column) -> Column:
    """A directory is a tree, a link to another repository has no kind here, the rest are blobs."""
    form = mode.bitwiseAND(0o170000)
    return F.when(form == 0o040000, "tree").when(form == 0o160000, F.lit(None)).otherwise("blob")


def join_path(prefix: Column, name: Column) -> Column:
    return F.when(prefix == "", name).otherwise(F.concat(prefix, F.lit("/"), name))


def ref_name_ok(name: Column, deleting: bool = False) -> Column:
    """Under refs/, two levels to set and one to delete, and well formed."""
    levels = r"^refs/[^/]+" if deleting else r"^refs/[^/]+/[^/]+"
    return name.rlike(levels) & ~name.rlike(r"//|\.\.|@\{|[\x00-\x20\x7f~^:?*\[\\]|/$|\.$|/\.|\.lock(/|$)")


def repo_key_ok(key: Column) -> Column:
    """Segments of letters, digits and ._- between slashes, at most 256 bytes."""
    return key.rlike(r"^[A-Za-z0-9._-]+(/[A-Za-z0-9._-]+)*$") & (F.octet_length(key) <= 256) & ~F.exists(F.split(key, "/"), lambda s: s.isin(".", ".."))


def mac_reads_as(name: Column, word: str) -> Column:
    """A dot and the word in any case, once the characters that HFS+ ignores are gone."""
    return F.regexp_replace(name, "[\u200c-\u200f\u202a-\u202e\u206a-\u206f\ufeff]", "").rlike(rf"^(?i:\.{word})\z")


def like_dot_git(name: Column) -> Column:
    """Names that a Mac or Windows checkout takes for ``.git``: blanks and dots may follow, or a stream's colon; so may one after a backslash."""
    return mac_reads_as(name, "git") | name.rlike(r"(?:^|\\)(?i:\.git|git~1)[ .]*(?:[/\\:]|\z)")


def like_dot_gitmodules(name: Column) -> Column:
    """The same for ``.gitmodules`` and the short names NTFS may give it: ``gitmod~1`` to ``~4``, or eight characters of ``gi7eba`` and a number."""
    fallback = "|".join(f"{'gi7eba'[:k]}~[1-9]" + (f"[0-9]{{{6 - k}}}" if k < 6 else "") for k in range(7))
    return mac_reads_as(name, "gitmodules") | name.rlike(rf"(?:^|\\)(?i:\.gitmodules|gitmod~[1-4]|{fallback})[ .]*(?::|\z)")


def path_ok(path: Column) -> Column:
    """No component that is empty, a dot, two dots, like .git, or holds a backslash or NUL."""
    return ~F.exists(F.split(path, "/"), lambda s: (s == "") | s.isin(".", "..") | like_dot_git(s) | s.contains("\\") | s.contains("\0"))


def lossy(raw: Column) -> Column:
    """Bytes as text; what isn't UTF-8 becomes the replacement character."""
    return F.make_valid_utf8(raw.cast("string"))


def identity_ok(name: Column, email: Column, seconds: Column, offset: Column) -> Column:
    clean = lambda c: (F.length(c) > 0) & ~c.rlike(r"[<>\n\x00]")
    return clean(name) & clean(email) & (seconds >= 0) & (offset % 60 == 0) & (F.abs(offset) <= 99 * 3600 + 59 * 60)


def layer_id(high: Column, generation: Column) -> Column:
    return F.concat(F.lpad(F.lower(F.hex(high)), 32, "0"), F.lit("-"), F.lpad(F.lower(F.hex(generation)), 16, "0"))


def layer_generation(layer: Column) -> Column:
    """Null unless the id is well formed."""
    return F.conv(F.nullif(F.regexp_extract(layer, r"^[0-9a-f]{32}-([0-9a-f]{16})$", 1), F.lit("")), 16, 10).cast("long")


def size_argument(text: str) -> int:
    """A C number with an optional k, m or g."""
    import re

    m = re.fullmatch(r"(0[xX][0-9a-fA-F]+|\d+)([kKmMgG]?)", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    base = 16 if m[1][:2].lower() == "0x" else 8 if m[1].startswith("0") and len(m[1]) > 1 else 10
    n = int(m[1], base) << {"": 0, "k": 10, "m": 20, "g": 30}[m[2].lower()]
    if n >= 1 << 64:
        raise ValueError("size too large")
    return n
