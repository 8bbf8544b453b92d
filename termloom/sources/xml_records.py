"""Records of large XML files, cut in many tasks.

Spark's text reader splits a file between tasks and ends a chunk at every closing row tag. Such a tag is a record's end
only outside comments, CDATA sections and processing instructions, and only if no row element inside the record is
open. What a task finds at its first byte depends on all of the file before. So a first pass, in column expressions,
works out for every chunk how it changes the state of the markup, for each state it may begin in, and composes the
changes of a split. The splits of a file are then composed in order, which gives the true state at each split's begin.

Files whose chunks are plain (no comment, CDATA section, instruction, nested, empty or oddly closed row element) need
no more: every chunk is a record. The others are scanned with the state known; records that run on into the next split
are put together by file. Well-formed files give the records that an XML parser sees.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from termloom.settings import stored

# States of the markup. The pairs are what opens and closes each but the first.
TEXT, COMMENT, CDATA, INSTRUCTION = range(4)
MARKS = {COMMENT: ("<!--", "-->"), CDATA: ("<![CDATA[", "]]>"), INSTRUCTION: ("<?", "?>")}
# Most files with odd markup that are named in a filter; more make all files go the same way.
NAMED_FILES = 1000

_OPENER = "|".join(re.escape(o) for o, _ in MARKS.values())
_DECLARATION = r"^\s*<\?xml\s[^>]*\?>"


def chunks(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(file, block, value): the text before each closing row tag, and before the end of a file, under the split that
    holds its begin. The XML declaration is taken off."""
    text = spark.read.option("lineSep", f"</{row_tag}>").text(path)
    value = F.when(F.col("value").contains("<?xml"), F.regexp_replace("value", _DECLARATION, "")).otherwise(F.col("value"))
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def _is_open(row_tag: str) -> str:
    return rf"<{row_tag}(?=[\s/>])"


def _is_empty(row_tag: str) -> str:
    """A row element without content; an attribute's value may hold a >."""
    return rf"""<{row_tag}(?:\s+[^\s=>/]+\s*=\s*(?:"[^"]*"|'[^']*'))*\s*/>"""


class Markup:
    """Reads row elements in text that begins in a known state."""

    def __init__(self, row_tag: str):
        self.token = re.compile(f"{_OPENER}|{_is_open(row_tag)}|</{row_tag}\\s*>")
        self.tag_end = re.compile(r"""(?:[^"'>]|"[^"]*"|'[^']*')*>""")
        self.closing = f"</{row_tag}>"
        self.state = TEXT

    def events(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(change of depth, begin, end) of every tag of a row element outside of sections; an empty element is one tag.
        Moves `state` to the end of the text."""
        at = 0
        while True:
            if self.state != TEXT:
                closer = MARKS[self.state][1]
                found = text.find(closer, at)
                if found < 0:
                    return
                at, self.state = found + len(closer), TEXT
            token = self.token.search(text, at)
            if token is None:
                return
            begin, at = token.span()
            opener = next((s for s, (o, _) in MARKS.items() if o == token.group()), None)
            if opener is not None:
                self.state = opener
            elif token.group().startswith("</"):
                yield -1, begin, at
            else:
                end = self.tag_end.match(text, at)
                at = end.end() if end else len(text)
                yield 0 if text[at - 2 : at] == "/>" else 1, begin, at

    def change(self, text: str, state: int) -> tuple[int, int]:
        """State and change of depth after a text that begins in `state`."""
        self.state = state
        depth = sum(change for change, _, _ in self.events(text))
        return self.state, depth


def split_changes(rows: DataFrame, row_tag: str) -> DataFrame:
    """(file, block, odd, states, depths): what every split does to the state that it begins in. Splits that change
    nothing are left out; only odd chunks and those without a record leave the JVM."""
    value = F.col("value")
    marked = F.lit(False)
    for mark in (m for pair in MARKS.values() for m in pair):
        marked = marked | value.contains(mark)
    opened = F.regexp_count(value, F.lit(_is_open(row_tag)))
    odd = marked | value.rlike(rf"</{row_tag}\s+>") | value.rlike(_is_empty(row_tag)) | (opened > 1)
    notable = rows.where(odd | (opened != 1)).select("file", "block", odd.alias("odd"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markup, found = Markup(row_tag), {}
        for batch in batches:
            for file, block, strange, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen, changes = found.get((file, block), (False, [(s, 0) for s in range(4)]))
                each = [markup.change(text + markup.closing, s) for s in range(4)]
                found[file, block] = seen or strange, [(each[s][0], depth + each[s][1]) for s, depth in changes]
        rows = [(file, block, seen, [c[0] for c in changes], [c[1] for c in changes]) for (file, block), (seen, changes) in found.items()]
        if rows:
            yield _batch_of(rows, _CHANGES)

    return notable.mapInArrow(run, "file string, block long, odd boolean, states array<int>, depths array<long>")


_CHANGES = pa.schema([
    ("file", pa.string()), ("block", pa.int64()), ("odd", pa.bool_()), ("states", pa.list_(pa.int32())), ("depths", pa.list_(pa.int64())),
])
# place, open: see `_scanned`.
_SCANNED = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("open", pa.bool_()), ("value", pa.string())])


def _batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(zip(*rows, strict=True), schema.types, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], schema=schema)


def _starts(changes: list) -> dict[str, tuple[list[int], list[tuple[int, int]]]]:
    """By file: blocks that change the state, in order, and (state, depth) after each."""
    after: dict[str, tuple[list[int], list[tuple[int, int]]]] = {}
    for row in sorted(changes, key=lambda r: (r["file"], r["block"])):
        blocks, states = after.setdefault(row["file"], ([], []))
        state, depth = states[-1] if states else (TEXT, 0)
        blocks.append(row["block"])
        states.append((row["states"][state], max(0, depth + row["depths"][state])))
    return after


class Scanner:
    """Cuts the chunks of one split into records, from a known state."""

    def __init__(self, row_tag: str, state: int, depth: int):
        self.markup = Markup(row_tag)
        self.markup.state, self.depth = state, depth
        self.parts: list[str] = []
        # A record that began in an earlier split ends here.
        self.continues = depth > 0

    def feed(self, chunk: str) -> Iterator[tuple[str, bool]]:
        """Records that end in the chunk, and whether they began before this split."""
        text, begin = chunk + self.markup.closing, 0
        for change, start, end in self.markup.events(text):
            if self.depth == 0:
                if change == 0:
                    yield text[start:end], False
                begin = start
            self.depth = max(0, self.depth + change)
            if change < 0 and self.depth == 0 and (self.parts or begin != start):
                yield "".join([*self.parts, text[begin:end]]), self.continues
                self.parts, self.continues = [], False
        if self.depth:
            self.parts.append(text[begin:])

    def rest(self) -> str | None:
        """What a record of this split leaves for the next ones."""
        return "".join(self.parts) if self.depth else None


def _scanned(rows: DataFrame, starts: dict, row_tag: str) -> DataFrame:
    """(file, block, place, value): whole records at place 1; at places 0 and 2 the end and the begin of records that run
    over splits, at place 0 with `open` those that run through the whole split."""
    known = rows.sparkSession.sparkContext.broadcast(starts)
    def state_at(file: str, block: int) -> tuple[int, int]:
        blocks, states = known.value.get(file, ([], []))
        i = bisect.bisect_left(blocks, block)
        return states[i - 1] if i else (TEXT, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, scanner = None, None

        def left() -> list[tuple]:
            rest = scanner.rest() if scanner else None
            return [] if rest is None else [(*here, 0 if scanner.continues else 2, True, rest)]

        for batch in batches:
            out = []
            for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here != (file, block):
                    out += left()
                    here, scanner = (file, block), Scanner(row_tag, *state_at(file, block))
                out += [(file, block, 0 if continued else 1, False, record) for record, continued in scanner.feed(value)]
            if out:
                yield _batch_of(out, _SCANNED)
        if rest := left():
            yield _batch_of(rest, _SCANNED)

    return rows.mapInArrow(run, "file string, block long, place int, open boolean, value string")


def _joined(parts: DataFrame) -> DataFrame:
    """Records that run over splits: each begins at place 2 and goes on at place 0 of the splits that follow."""
    order = Window.partitionBy("file").orderBy("block", "place")
    numbered = parts.withColumn("record", F.sum(F.when(F.col("place") == 2, 1).otherwise(0)).over(order))
    whole = numbered.groupBy("file", "record").agg(F.sort_array(F.collect_list(F.struct("block", "place", "open", "value"))).alias("parts"))
    # A record that nothing closes is none.
    closed = ~F.element_at("parts", -1)["open"]
    return whole.where(closed).select(F.array_join("parts.value", "").alias("value"))


def _plain(rows: DataFrame, row_tag: str) -> DataFrame:
    """The record of every chunk that has one."""
    record = F.concat(F.regexp_extract("value", rf"(?s){_is_open(row_tag)}.*", 0), F.lit(f"</{row_tag}>"))
    return rows.where(F.col("value").rlike(_is_open(row_tag))).select(record.alias("value"))


def records(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    """(value): the text of every row element of the files at `path`, split between tasks.

    One pass over the files runs at once. The driver gets one row for each split that changes the state in a file with
    odd markup; Spark's planner holds all splits anyway.
    """
    rows = chunks(spark, path, row_tag)
    changes = stored(split_changes(rows, row_tag), "xml_splits")
    odd = [r["file"] for r in changes.where("odd").select("file").distinct().limit(NAMED_FILES + 1).collect()]
    if not odd:
        return _plain(rows, row_tag)
    named = F.col("file").isin(odd)
    every = len(odd) > NAMED_FILES
    starts = _starts((changes if every else changes.where(named)).collect())
    # A filter by file alone would leave files unread and so cut the others into other splits than the first pass.
    found = _scanned(rows if every else rows.where(F.when(F.col("value").isNotNull(), named)), starts, row_tag)
    whole = found.where("place = 1").select("value").unionByName(_joined(found.where("place <> 1")))
    if every:
        return whole
    return _plain(rows.where(~named), row_tag).unionByName(whole)
