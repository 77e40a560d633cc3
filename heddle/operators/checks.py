"""Checks of commits and tags as text, what an object refers to, and trees as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.scalars import size_argument

#: A line up to its end; what follows a line; an id.
LINE, ID = r"[^\n]*\n", "[0-9a-f]{40}"


def identity_fault(line: Column) -> Column:
    """The first fault of ``Name <mail> seconds ±zone``; null if there is none."""
    date = F.regexp_extract(line, r"^[^<>]*<[^<>]*> [ \t]*([0-9]*)", 1)
    return (
        F.when(line.startswith("<"), "NO_SPACE_BEFORE_EMAIL")
        .when(line.rlike(r"^[^<>]*>"), "BAD_NAME")
        .when(~line.contains("<"), "NO_EMAIL")
        .when(~line.rlike(r"^[^<>]* <"), "NO_SPACE_BEFORE_EMAIL")
        .when(~line.rlike(r"^[^<>]*<[^<>]*>"), "BAD_EMAIL")
        .when(~line.rlike(r"^[^<>]*<[^<>]*> "), "NO_SPACE_BEFORE_DATE")
        .when(date == "", "BAD_DATE")
        .when(line.rlike(r"> [ \t]*0[^ ]") | line.rlike(r"> [ \t]*0$"), "ZERO_PADDED_DATE")
        .when(date.try_cast("long").isNull(), "DATE_OVERFLOW")
        .when(~line.rlike(r"> [ \t]*[0-9]+ "), "BAD_DATE")
        .when(~line.rlike(r"> [ \t]*[0-9]+ [+-][0-9]{4}$"), "BAD_ZONE")
    )


def header_fault(content: Column) -> Column:
    """Headers end before any NUL, at a blank line or at the final newline."""
    head = F.substring_index(content, "\n\n", 1)
    return F.when(head.contains("\0"), "NUL_IN_HEADER").when(~content.contains("\n\n") & ~content.endswith("\n"), "UNTERMINATED_HEADER")


def commit_fault(content: Column) -> Column:
    """The first fault of a commit's text: its headers in order, both identities, no NUL; null if there is none."""
    start = rf"^tree {ID}\n(?:parent {ID}\n)*"
    after = F.regexp_replace(content, start, "")
    authors = F.regexp_extract(after, rf"^((?:author {LINE})*)", 1)
    each = F.filter(F.split(authors, "\n"), lambda x: x != "")
    author_fault = F.get(F.filter(F.transform(each, lambda x: identity_fault(F.substring(x, F.lit(8), F.length(x)))), lambda f: f.isNotNull()), F.lit(0))
    rest = F.substring(after, F.length(authors) + 1, F.length(after))
    committer = F.regexp_extract(rest, r"^committer ([^\n]*)\n", 1)
    return F.coalesce(
        header_fault(content),
        F.when(~content.startswith("tree "), "NO_TREE").when(~content.rlike(rf"^tree {ID}\n"), "BAD_TREE").when(after.startswith("parent "), "BAD_PARENT"),
        author_fault,
        F.when(F.size(each) == 0, "NO_AUTHOR").when(F.size(each) > 1, "MANY_AUTHORS").when(~rest.startswith("committer "), "NO_COMMITTER"),
        identity_fault(committer),
        F.when(content.contains("\0"), "NUL_IN_BODY"),
    )


def tag_fault(content: Column) -> Column:
    """The first fault of a tag's text; a bad tagger counts only where no header follows it."""
    head = rf"^object {ID}\ntype [^\n]*\n"
    tagger = F.regexp_extract(content, rf"{head}tag {LINE}tagger ([^\n]*)\n(?:\n|$)", 1)
    return F.coalesce(
        F.when(F.octet_length(content) < 64, "TOO_SHORT"),
        header_fault(content),
        F.when(~content.startswith("object "), "NO_OBJECT").when(~content.rlike(rf"^object {ID}\n"), "BAD_OBJECT"),
        F.when(~content.rlike(rf"^object {ID}\ntype "), "NO_TYPE").when(~content.rlike(rf"^object {ID}\ntype (commit|tree|blob|tag)\n"), "BAD_TYPE"),
        F.when(~content.rlike(rf"{head}tag "), "NO_TAG_NAME").when(~content.rlike(rf"{head}tag {LINE}"), "UNTERMINATED_TAG_NAME"),
        F.when(content.rlike(rf"{head}tag {LINE}tagger [^\n]*\n(?:\n|$)"), identity_fault(tagger)),
    )


def references(commits: DataFrame, entries: DataFrame, tags: DataFrame) -> DataFrame:
    """(source, oid, kind) of what objects refer to.

    ``commits``: oid, tree, parents; ``entries``: tree, mode, oid (links to other repositories count for nothing);
    ``tags``: oid, target, kind.
    """
    from heddle.functions.scalars import mode_kind

    to_tree = commits.select(F.col("oid").alias("source"), F.col("tree").alias("oid"), F.lit("tree").alias("kind"))
    to_parent = commits.select(F.col("oid").alias("source"), F.explode("parents").alias("oid"), F.lit("commit").alias("kind"))
    to_entry = entries.select(F.col("tree").alias("source"), "oid", mode_kind(F.col("mode")).alias("kind")).where("kind is not null")
    to_target = tags.select(F.col("oid").alias("source"), F.col("target").alias("oid"), "kind")
    return to_tree.unionByName(to_parent).unionByName(to_entry).unionByName(to_target)


def tree_bytes(entries: DataFrame) -> DataFrame:
    """(tree, content) from entries (tree, mode as octal text, name, oid), ordered with directories as ``name/``."""
    line = F.hex(F.concat(F.concat_ws(" ", "mode", "name").cast("binary"), F.lit(b"\0"), F.unhex("oid")))
    key = F.concat("name", F.when(F.col("mode") == "40000", "/").otherwise("")).cast("binary")
    lines = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), line.alias("line")))), lambda e: e["line"])
    return entries.groupBy("tree").agg(F.unhex(F.array_join(lines, "")).alias("content"))


def parse_trees(trees: DataFrame, id_bytes: int = 20) -> DataFrame:
    """(tree, ord, mode, name, oid) of the entries of trees (tree, content) in stored order; cut short content is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for tree, content in zip(batch.column("tree").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at, place, content = 0, 0, content or b""
                while at < len(content):
                    blank, end = content.index(b" ", at), content.index(b"\0", at)
                    oid = content[end + 1 : end + 1 + id_bytes]
                    if len(oid) < id_bytes:
                        raise ValueError("a tree is cut short")
                    rows.append((tree, place, int(content[at:blank], 8), content[blank + 1 : end], oid.hex()))
                    at, place = end + 1 + id_bytes, place + 1
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [batch.schema.field("tree").type, pa.int32(), pa.int32(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["tree", "ord", "mode", "name", "oid"])

    kind = trees.schema["tree"].dataType.simpleString()
    return trees.select("tree", F.col("content").cast("binary").alias("content")).mapInArrow(run, f"tree {kind}, ord int, mode int, name binary, oid string")


def of_kind(objects: DataFrame, kind: str) -> DataFrame:
    """The objects of one kind; a lookup by id and kind is a filter on both."""
    return objects.where(F.col("kind") == kind)


def within_limit(objects: DataFrame, max_bytes: int = 100 << 20) -> DataFrame:
    """The objects (size) that are small enough to be stored."""
    return objects.where(F.col("size") <= max_bytes)


def filtered(objects: DataFrame, spec: str) -> DataFrame:
    """The objects (kind, size, wanted) that a fetch sends under ``blob:none``, ``blob:limit=n`` or ``tree:0``; wanted ones always."""
    if spec == "blob:none":
        keep = F.col("kind") != "blob"
    elif spec.startswith("blob:limit="):
        keep = (F.col("kind") != "blob") | (F.col("size") < size_argument(spec.removeprefix("blob:limit=")))
    elif spec == "tree:0":
        keep = ~F.col("kind").isin("blob", "tree")
    else:
        raise ValueError(f"unsupported filter {spec!r}")
    return objects.where(keep | F.col("wanted"))
