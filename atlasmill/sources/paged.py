"""Saved responses of paged services, and single documents too large to be parsed at once.

Both are read by Spark's own file sources, so they work on any store that Spark reads. A page is a task's worth of rows;
a large document is cut at closing braces by the text source, and its blocks are read apart, element by element.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasmill.config import DEFAULT, Params
from atlasmill.session import materialize
from atlasmill.sources.payloads import normalized_rows

RESPONSE = (
    "success boolean, error struct<message:string>, extracted_at string, dataset struct<name:string,license_id:string>, "
    "result struct<resource_id:string,offset:bigint,limit:bigint,total:bigint,records:array<map<string,string>>>"
)


def _demand(condition: Column, message: Column) -> Column:
    """True, or the end of the job."""
    return F.assert_true(F.coalesce(condition, F.lit(False)), message).isNull()


def read_pages(spark: SparkSession, path: str, last_offset: int | None = None) -> DataFrame:
    """Records of all resources: extracted_at, origin, d (name, license_id), r (id), pos (over all pages), row.

    One response a line. A response without success is an error, as is a page that is missing between others. A resource
    ends with its first page that is not full, and after last_offset if one is given; a page that was saved twice counts once.
    """
    raw = spark.read.schema(RESPONSE).json(path)
    at = F.concat(F.lit("no success: "), F.coalesce("result.resource_id", F.lit("?")), F.lit(" "), F.coalesce("error.message", F.lit("")))
    pages = raw.where(_demand(F.col("success"), at)).select("extracted_at", "dataset", "result.*")
    if last_offset is not None:
        pages = pages.where(F.col("offset") <= last_offset)
    key = F.coalesce("extracted_at", F.lit(""))
    light = pages.select(key.alias("_at"), "resource_id", "offset", F.col("limit").alias("size"), F.coalesce(F.size("records"), F.lit(0)).alias("n")).distinct()
    ends = light.groupBy(F.col("_at").alias("_when"), F.col("resource_id").alias("_id")).agg(F.coalesce(F.min(F.when(F.col("n") < F.col("size"), F.col("offset"))), F.max("offset")).alias("end"), F.max("size").alias("size"))
    one = (F.col("_at") == F.col("_when")) & F.col("resource_id").eqNullSafe(F.col("_id"))
    there = light.drop("size").join(ends, one).where(F.col("offset") <= F.col("end")).groupBy("_when", "_id", "end", "size").agg(F.countDistinct("offset").alias("there"))
    whole = F.col("there") == F.floor(F.col("end") / F.col("size")) + 1
    ends = there.where(_demand(whole, F.concat(F.lit("a page is missing: "), F.coalesce("_id", F.lit("?"))))).select("_when", "_id", "end")
    kept = pages.withColumn("_at", key).join(ends, one).where(F.col("offset") <= F.col("end")).drop("_at", "_when", "_id", "end")
    once = kept.dropDuplicates(["extracted_at", "resource_id", "offset"])
    rows = once.select(F.col("extracted_at").try_cast("timestamp").alias("extracted_at"), F.lit(None).cast("string").alias("origin"), F.col("dataset").alias("d"), F.struct(F.col("resource_id").alias("id")).alias("r"), "offset", F.posexplode("records").alias("i", "row"))
    return rows.select("extracted_at", "origin", "d", "r", (F.col("offset") + F.col("i")).alias("pos"), "row")


def paged_places(spark: SparkSession, path: str, params: Params = DEFAULT) -> DataFrame:
    """Places of all pages below path; ord is the record's place in its resource."""
    rows = read_pages(spark, path)
    return normalized_rows(rows.withColumn("dpos", F.lit(0)).withColumn("rpos", F.lit(0)), params)


STRUCTURE = re.compile(r'[\\"{}\[\]]')


#: Blocks of documents up to which their table is broadcast; beyond, pieces are shuffled to it.
BROADCAST_BLOCKS = 50_000


class _Elements:
    """Finds the objects of one array of the outermost object, piece by piece; pieces end with a closing brace.

    It may begin at any piece, if told what the pieces before leave: whether a string is open, the depth, whether that is
    inside the array, how many elements have begun, and whether the last of them has not ended.
    """

    def __init__(self, field: str, quoted: bool = False, depth: int = 0, inside: bool = False, begun: int = 0, within: bool = False):
        self.key, self.quoted, self.depth, self.inside, self.begun, self.within, self.held = f'"{field}"', quoted, depth, inside, begun, within, []

    def feed(self, piece: str) -> Iterator[str]:
        """Elements that the piece ends. One that began before is its end only."""
        start = at = 0
        while match := STRUCTURE.search(piece, at):
            at, mark = match.end(), match.group()
            if mark == "\\":
                at += 1
            elif mark == '"':
                self.quoted = not self.quoted
            elif not self.quoted:
                if mark in "{[":
                    if mark == "[" and self.depth == 1:
                        self.inside = piece[: at - 1].rstrip().removesuffix(":").rstrip().endswith(self.key)
                    if mark == "{" and self.depth == 2 and self.inside:
                        start, self.held, self.within = at - 1, [], True
                        self.begun += 1
                    self.depth += 1
                else:
                    self.depth -= 1
                    if self.within and self.depth == 2:
                        yield "".join(self.held) + piece[start:at]
                        self.held, self.within = [], False
                    if self.depth == 1:
                        self.inside = False
        if self.within:
            self.held.append(piece[start:])


class _Levels:
    """What a block does to the depth, and how many elements begin in it, when the depth it begins at is not known.

    Inside a document the depth is 1 at least. So the lowest level of a block is depth 1, or 2, or it lies within an
    element and none begins: the numbers for the first two are kept.
    """

    def __init__(self, field: str):
        self.key, self.level, self.low, self.opened, self.before, self.after, self.inside, self.last = f'"{field}"', 0, 0, Counter(), 0, 0, False, {}

    def mark(self, mark: str, piece: str, at: int) -> None:
        if mark in "{[":
            if mark == "[" and self.level == self.low:
                self.inside = piece[: at - 1].rstrip().removesuffix(":").rstrip().endswith(self.key)
            self.last[self.level] = mark
            if mark == "{":
                self.opened[self.level] += 1
                self.after += self.level == self.low + 1 and self.inside
            self.level += 1
        else:
            self.level -= 1
            if self.level < self.low:  # what began one level higher, began before this level was met
                self.low, self.before, self.after = self.level, self.opened[self.level + 1], 0
            if self.level == self.low:
                self.inside = False

    def row(self, quoted: bool) -> tuple:
        return quoted, self.level, self.low, self.opened[self.low], self.before, self.after, self.inside, self.last.get(self.low) == "{", self.last.get(self.low + 1) == "{"


HALF = "quoted boolean, level long, low long, opened long, before long, after long, inside boolean, within boolean, above boolean"
BLOCK = "quoted boolean, depth long, inside boolean, begun long, within boolean"


def _blocks(pieces: DataFrame, field: str) -> DataFrame:
    """origin, block and what holds where each block begins: quoted, depth, inside, begun, within.

    A block is looked through once for both cases, that it begins within a string and that it does not; a mark outside
    strings in the one case is inside in the other. A document's blocks, a few numbers each, are then gone through in order.
    """
    fields = [f"{c.split()[0]}{i} {c.split()[1]}" for i in range(2) for c in HALF.split(", ")]
    schema = ", ".join(["origin string", "block long", *fields])

    def looked_through(batches):
        now, levels, odd, whole = None, (), False, None

        def row():
            if whole is not None:  # the first block of a document: nothing is unknown
                return (*now, whole.quoted, whole.depth, 0, whole.begun, 0, 0, whole.inside, whole.within, False, *[None] * 9)
            return (*now, *levels[0].row(odd), *levels[1].row(not odd))

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(types)], names=names)

        names = [x.split()[0] for x in schema.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in schema.split(", ")]
        for batch in batches:
            out = []
            for *place, value in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if place != now:
                    if now is not None:
                        out.append(row())
                    now, levels, odd = place, (_Levels(field), _Levels(field)), False
                    whole = _Elements(field) if place[1] == 0 else None
                piece, at = value + "}", 0
                if whole is not None:
                    for _ in whole.feed(piece):
                        pass
                    continue
                while match := STRUCTURE.search(piece, at):
                    at, mark = match.end(), match.group()
                    if mark == "\\":
                        at += 1
                    elif mark == '"':
                        odd = not odd
                    else:
                        levels[odd].mark(mark, piece, at)
            if out:
                yield table(out)
        if now is not None:
            yield table([row()])

    def in_order(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        quoted, depth, inside, begun, within, out = False, 0, False, 0, False, []
        for r in rows:
            out.append((r["origin"], r["block"], quoted, depth, inside, begun, within))
            if r["block"] == 0:
                quoted, depth, inside, begun, within = (r[f"{c}0"] for c in ("quoted", "level", "inside", "opened", "within"))
                continue
            end, level, low, opened, before, after, array, first, second = (r[f"{c.split()[0]}{int(quoted)}"] for c in HALF.split(", "))
            if depth + low <= 1:
                begun, inside = begun + after + (before if inside else 0), array
                within = array and second and depth + level > 2
            elif depth + low == 2:
                begun += opened if inside else 0
                within = inside and first and depth + level > 2
            quoted, depth = end, depth + level
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["origin", "block", "quoted", "depth", "inside", "begun", "within"])

    found = pieces.select("origin", "block", "value").mapInArrow(looked_through, schema)
    return found.groupBy("origin").applyInArrow(in_order, f"origin string, block long, {BLOCK}")


def stream_elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """origin, pos, element (JSON text) of the array `field` of each document below path, one document a file.

    A document is read twice, in the blocks that its file is split into, all at the same time: once for where each block
    begins, then for the elements. A task holds one element, however large the document is; the parts of an element that
    blocks cut are put together after that. Null and numbers in the array are passed over. Pieces end with a closing
    brace, so the field's name must not hold one.
    """
    if "}" in field:
        raise ValueError("the field's name holds a closing brace")
    pieces = spark.read.option("lineSep", "}").text(path)
    pieces = pieces.select(F.col("_metadata.file_path").alias("origin"), F.col("_metadata.file_block_start").alias("block"), "value")
    blocks = materialize(_blocks(pieces, field), "blocks")
    if blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS:
        known = pieces.join(F.broadcast(blocks), ["origin", "block"], "left")
    else:
        known = pieces.withColumn("seq", F.monotonically_increasing_id()).join(blocks.hint("merge"), ["origin", "block"], "left")
        known = known.repartition("origin", "block").sortWithinPartitions("origin", "block", "seq")

    def run(batches):
        now, finder, first = None, None, 0

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["origin", "pos", "block", "part"])

        def rest():
            return [(*now[:1], finder.begun - 1, now[1], "".join(finder.held))] if finder is not None and finder.within else []

        for batch in batches:
            out = []
            for origin, block, value, *state in zip(*(batch.column(i).to_pylist() for i in range(8))):
                if (origin, block) != now:
                    out += rest()
                    if None in state:
                        raise ValueError(f"{origin} was split in another way at {block}")
                    now, finder = (origin, block), _Elements(field, *state)
                for element in finder.feed(value + "}"):
                    out.append((origin, finder.begun - 1, block, element))
            if out:
                yield table(out)
        if out := rest():
            yield table(out)

    def whole(batches):
        at, parts = None, []

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.string()))], names=["origin", "pos", "element"])

        for batch in batches:
            out = []
            for origin, pos, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (origin, pos) != at:
                    if parts:
                        out.append((*at, "".join(parts)))
                    at, parts = (origin, pos), []
                parts.append(part)
            if out:
                yield table(out)
        if parts:
            yield table([(*at, "".join(parts))])

    found = known.select("origin", "block", "value", *[c.split()[0] for c in BLOCK.split(", ")]).mapInArrow(run, "origin string, pos long, block long, part string")
    near = found.repartition("origin", F.floor(F.col("pos") / 1000)).sortWithinPartitions("origin", "pos", "block")
    return near.select("origin", "pos", "part").mapInArrow(whole, "origin string, pos long, element string")


def streamed_payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A payload of one-element documents in the order of the large ones: for the readers in payloads, with origin and pos."""
    field, kind = schema.split(" ", 1)
    item = kind.removeprefix("array<")[:-1]
    rows = stream_elements(spark, path, field)
    return rows.select(F.array(F.from_json("element", item)).alias(field), "origin", "pos")
