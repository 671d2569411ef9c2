"""Records of JSON array files, read in splits: one large array is many tasks' work, and a limit reads only what it needs.

Spark's text reader cuts a file at its ``}`` bytes, so each split begins right after one and no split begins inside an escape.
Whether a split begins inside a string, how deep, and inside the wanted array or not, follows from the splits before it. So there are two passes:

1. Each split is scanned once as if it began outside a string and once as if inside; its row says, for either case, in which state
   it ends and how many records end in it, by the depth at its beginning. The driver chains these rows, one for each split, and knows
   each split's state and the number of its first record.
2. Splits are scanned again from their true state. Records that lie in one split are emitted where they are; parts of records
   that cross borders, at most two a split, are joined by record.

With a limit, the first pass reads splits in growing waves until enough records end in them, and the second one leaves each file where it is reached.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corvane.scratch import Scratch

#: A whole string, or one that the text's end leaves open (then group 1 is empty), or a bracket.
_TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*("|\Z)|[\[\]{}]', re.S)
_STRING_END = re.compile(r'[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: A split may begin this deep; deeper nesting at a border is an error, not a wrong result.
DEEPEST = 64
IN_FIELD, ELSEWHERE = 1, 0


class Scanner:
    """Reads a split's text piece by piece. Depths count from the split's beginning, which is 0.

    ``last`` has, for each depth, whether the last bracket that opened or closed there entered the wanted array. ``ended`` counts objects
    that ended at a depth (key: the depth they ended at, and the value of ``last`` one level up then, or None where it wasn't touched).
    """

    def __init__(self, field: str, in_string: bool):
        self.field, self.in_string, self.depth = field, in_string, 0
        self.last: dict[int, int] = {}
        self.ended: dict[tuple[int, int | None], int] = {}

    def feed(self, text: str) -> Iterator[tuple[str, int]]:
        """Yields ('{' or '}', position) of each object that opens or ends, after the state has changed."""
        at = 0
        if self.in_string:
            end = _STRING_END.match(text)
            if not end:
                return
            self.in_string, at = False, end.end()
        key, key_end = None, 0
        for token in _TOKEN.finditer(text, at):
            what = text[token.start()]
            if what == '"':
                if not token.group(1):
                    self.in_string = True
                    return
                key, key_end = token.group(), token.end()
            elif what in "[{":
                named = what == "[" and key is not None and text[key_end : token.start()].strip() == ":" and self._is_field(key)
                self.last[self.depth] = IN_FIELD if named else ELSEWHERE
                self.depth += 1
                if what == "{":
                    yield "{", token.start()
            else:
                self.depth -= 1
                if what == "}":
                    where = self.depth, self.last.get(self.depth - 1)
                    self.ended[where] = self.ended.get(where, 0) + 1
                    yield "}", token.start()
                else:
                    self.last[self.depth] = ELSEWHERE

    def _is_field(self, key: str) -> bool:
        try:
            return json.loads(key) == self.field
        except ValueError:
            return False


def fixed_splits(spark: SparkSession) -> SparkSession:
    """A session with the same settings whose file readers cut at multiples of ``maxPartitionBytes``, however many cores or files there are."""
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.get(key, None) != value and spark.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.files.minPartitionNum", "1")
    return session


def splits(spark: SparkSession, path) -> DataFrame:
    """(file, at, text): what lies between ``}`` bytes, with the beginning of its split. ``spark`` is a session of fixed splits."""
    rows = spark.read.option("lineSep", "}").text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").alias("text"))


def _runs(batches) -> Iterator[tuple[str, int, str]]:
    """(file, at, text) of the batches' rows, joined with their ``}`` as long as they are of one split; a split may come in several runs.

    White space after a file's last ``}`` is a row too and gets one more; below the root's end that changes nothing.
    """
    for batch in batches:
        files, starts = batch.column("file").dictionary_encode(), batch.column("at").to_numpy()
        codes, names, texts = files.indices.to_numpy(), files.dictionary.to_pylist(), batch.column("text").to_pylist()
        first = 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or codes[i] != codes[first] or starts[i] != starts[first]:
                yield names[codes[first]], int(starts[first]), "}".join(texts[first:i]) + "}"
                first = i


_SUMMARY = "file string, at long, inside boolean, ends_inside boolean, depth int, last map<int,int>, ended array<struct<depth: int, section: int, n: long>>"


def summaries(segments: DataFrame, name: str) -> DataFrame:
    """Two rows for each split: what scanning it does if it begins outside a string, and if inside."""

    def run(batches):
        scanners: dict[tuple[str, int], list[Scanner]] = {}
        for file, at, text in _runs(batches):
            for scanner in scanners.setdefault((file, at), [Scanner(name, False), Scanner(name, True)]):
                for _ in scanner.feed(text):
                    pass
        rows = []
        for (file, at), both in scanners.items():
            for inside, s in zip((False, True), both, strict=True):
                near = lambda d: -DEEPEST <= d <= 3  # noqa: E731  depths that an array at a true depth of 1 or 0 can have from here
                ended = [{"depth": d, "section": w, "n": n} for (d, w), n in s.ended.items() if near(d)]
                rows.append({"file": file, "at": at, "inside": inside, "ends_inside": s.in_string, "depth": s.depth, "last": [(d, w) for d, w in s.last.items() if near(d)], "ended": ended})
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = to_arrow_schema(T._parse_datatype_string(_SUMMARY))
    return segments.mapInArrow(run, _SUMMARY)


@dataclass
class State:
    """How a split begins: inside a string, how deep, in the wanted array or not, and after how many of its file's records."""

    in_string: bool = False
    depth: int = 0
    section: int = ELSEWHERE
    before: int = 0


@dataclass
class Chained:
    """States of one file's splits, in order, and the file's number of records in the splits seen."""

    states: dict[int, State] = field(default_factory=dict)
    records: int = 0


def chain(rows, level: int) -> Chained:
    """States of a file's splits from their summaries. ``level``: depth of the wanted array's records, 2 below a root object, 1 in a root array."""
    both: dict[int, dict[bool, object]] = {}
    for r in rows:
        both.setdefault(r["at"], {})[r["inside"]] = r
    out, state = Chained(), State(section=IN_FIELD if level == 1 else ELSEWHERE)
    for at in sorted(both):
        out.states[at] = state
        if state.depth > DEEPEST:
            raise ValueError(f"a split begins {state.depth} levels deep")
        r = both[at][state.in_string]
        ended = {(e["depth"], e["section"]): e["n"] for e in r["ended"]}
        own = level - state.depth  # where records end, counted from the split's beginning
        n = ended.get((own, IN_FIELD), 0) + (ended.get((own, None), 0) if state.section == IN_FIELD else 0)
        if level == 1:
            n = sum(k for (d, _), k in ended.items() if d == own)
        section = (r["last"] or {}).get(own - 1, state.section) if level > 1 else IN_FIELD
        state = State(r["ends_inside"], state.depth + r["depth"], section, state.before + n)
    out.records = state.before
    return out


def _scan(segments: DataFrame, states: dict[str, dict[int, State]], name: str, level: int, partial: bool, limit: int | None, read=None) -> DataFrame:
    """(file, ord, at, record): whole records, or with ``partial`` the parts of those that cross a split's border."""
    schema = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("at", pa.int64()), ("record", pa.string())])

    def of_split(runs, state: State):
        """Parts of one split's records as (ord, text, whole); None when the limit is reached."""
        scanner = Scanner(name, state.in_string)
        own, number = level - state.depth, state.before
        opened = state.depth > level and state.section == IN_FIELD  # a record is open at the beginning
        held, whole = [], not opened
        for text in runs:
            begin = 0 if opened else None
            for what, place in scanner.feed(text):
                section = IN_FIELD if level == 1 else scanner.last.get(own - 1, state.section)
                if section != IN_FIELD:
                    continue
                if what == "{" and scanner.depth == own + 1:
                    begin, held, whole, opened = place, [], True, True
                elif what == "}" and scanner.depth == own and opened:
                    yield number, "".join(held) + text[begin : place + 1], whole
                    number, begin, held, opened = number + 1, None, [], False
                    if limit is not None and number >= limit:
                        yield None
                        return
            if opened:
                held.append(text[begin:])
        if opened:
            yield number, "".join(held), False

    def found(batches):
        """(file, ord, at, record) of the wanted kind."""
        runs = itertools.groupby(_runs(batches), key=lambda r: r[:2])
        for (file, at), same in runs:
            state = states.get(file, {}).get(at)
            if limit is not None and (state is None or state.before >= limit):
                return  # of one file, in order: nothing behind it is wanted
            for part in of_split(_counted(same, read), state):
                if part is None:
                    return
                if part[2] != partial:
                    yield file, part[0], at, part[1]

    def run(batches):
        rows, size = [], 0
        for row in found(batches):
            rows.append(row)
            size += len(row[3])
            if size > 1 << 22:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return segments.mapInArrow(run, "file string, ord long, at long, record string")


def _counted(runs, read) -> Iterator[str]:
    for _, _, text in runs:
        if read is not None:
            read.add(len(text))
        yield text


def records(spark: SparkSession, path: str, name: str | None = "KARARLAR", limit: int | None = None, read=None) -> DataFrame:
    """(ord, record): the objects of the array ``name`` of each file's root object, or of a root array without ``name``, as JSON text.

    ``ord`` counts from 0 over the files in the order of their paths; the first ``limit`` are returned. Files hold valid JSON in UTF-8. Other
    fields of the root, elements that aren't objects and an empty or missing array give no rows; brackets, quotes and escapes inside strings don't
    matter. ``read``, an accumulator, counts the characters that the second pass looks at. A name with ``}`` is refused, since files are cut there.
    """
    if name is not None and "}" in name:
        raise ValueError("the field's name can't hold a }")
    level, key = (1, "") if name is None else (2, name)
    cut = fixed_splits(spark)
    found: dict[str, Chained] = {}
    if limit is None:
        rows: dict[str, list] = {}
        for r in summaries(splits(cut, path), key).collect():  # two for each split
            rows.setdefault(r["file"], []).append(r)
        found = {file: chain(rows[file], level) for file in sorted(rows)}
        sources = [(splits(cut, path), None)]
    else:
        used, total = [], 0
        for file in sorted(spark.read.text(path).inputFiles()):
            if total >= limit:
                break
            here, wave = summaries(splits(cut, file), key), 2
            while True:
                seen = here.take(wave)  # runs the first splits only, then more
                done = chain(seen, level)
                if len(seen) < wave or total + done.records >= limit:
                    break
                wave *= 4
            used.append(file)
            found.update({r["file"]: done for r in seen[:1]})
            total += done.records
        sources = [(splits(cut, used[:-1]), None)] * (len(used) > 1) + [(splits(cut, used[-1]), limit)] * bool(used)
    if not found:
        return spark.createDataFrame([], "ord long, record string")
    states, count = {}, 0
    for file, done in sorted(found.items()):
        states[file] = {at: State(s.in_string, s.depth, s.section, s.before + count) for at, s in done.states.items()}
        count += done.records
    scan = lambda partial, read=None: reduce(DataFrame.unionByName, [_scan(rows, states, key, level, partial, most, read) for rows, most in sources])
    parts = Scratch(spark, "json").table("parts", scan(True))
    joined = parts.groupBy("ord").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "record"))), lambda p: p.record), "").alias("record"))
    joined = joined.filter(F.col("ord") < limit) if limit is not None else joined
    return joined.unionByName(scan(False, read).select("ord", "record"))  # in this order, so that the result is the caller's session's


def parsed(rows: DataFrame, schema: T.StructType, record: Column | str = "record") -> DataFrame:
    """Records as columns, beside ord."""
    return rows.select("ord", F.from_json(record, schema).alias("r")).select("ord", "r.*")


def write(rows: DataFrame, path: str, name: str = "KARARLAR") -> None:
    """One JSON file for each partition: a root object whose array ``name`` holds the rows."""
    opening, closing = f"{{{json.dumps(name)}:[", "]}"

    def run(batches):
        first = True
        for batch in batches:
            lines = ["," + t for t in batch.column("record").to_pylist()]
            if first and lines:
                lines[0] = opening + lines[0][1:]
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([opening + closing if first else closing])], names=["value"])

    rows.select(F.to_json(F.struct(*rows.columns)).alias("record")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
