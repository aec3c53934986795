"""Evaluation documents of any size: one JSON object with all prompts in it, read by many tasks.

``{"label": .., "ckpt_path": .., "n_rollouts": .., "datasets": {name: {"n_prompts": .., "pass_at_k": {..}, "per_prompt": [{..}, ..]}}}``

A document is cut into byte ranges. The text ``"problem_id":`` with bare quotes can only be a key, wherever in the file a
task begins: inside a string a quote has a backslash before it. From such a key a task follows brackets and strings to the
end of the record, and owns the records after it. Values that are not asked for are skipped as they are read, so a task holds
a record's wanted fields and a chunk of the file.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import _parse_datatype_string

from rollspark.sources.scratch import shared_path

TOP = "label string, ckpt_path string, n_rollouts int"
SECTION = f"path string, at long, {TOP}, dataset string, n_prompts long, pass_at_k map<string, double>, mean_reward_at_1 double"
RECORD = f"{TOP}, dataset string, problem_id string, ground_truth string, n_correct long, rewards array<double>, preds array<string>, rollouts array<string>"

_STRING = rb'"(?:[^"\\]++|\\.)*+"'
STRING = re.compile(_STRING, re.S)
SCALAR = re.compile(rb'[^\s"{}\[\],:]++')
BLANK = re.compile(rb"\s*+")
#: Up to and with the next bracket outside strings.
BRACKET = re.compile(rb'[^"{}\[\]]*+(?:' + _STRING + rb'[^"{}\[\]]*+)*+([{}\[\]])', re.S)
RECORD_KEY, LIST_KEY = b"problem_id", b"per_prompt"
#: Longest run of blanks that is looked for between a key and its colon or bracket.
SLACK = 64


def key_pattern(key: bytes, then: bytes) -> re.Pattern:
    return re.compile(rb'(?<!\\)"' + re.escape(key) + rb'"\s{0,30}:' + then)


ANCHOR = key_pattern(RECORD_KEY, b"")
LIST = key_pattern(LIST_KEY, rb"\s{0,30}\[")


def opened(path: str):
    """(stream, size) of a file in any store that pyarrow reads; ``file:/x`` is how Hadoop writes a local path."""
    path = re.sub(r"^file:/+", "file:///", path)
    fs, at = pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)
    return fs.open_input_file(at), fs.get_file_info(at).size


class Scanner:
    """A cursor over a file from an offset on, with a buffer of what has been read and not passed."""

    def __init__(self, stream, at: int, chunk: int = 1 << 20):
        self.stream, self.chunk, self.base, self.buf, self.i, self.mark, self.peak = stream, chunk, at, b"", 0, None, 0
        stream.seek(at)

    def more(self) -> bool:
        drop = self.i if self.mark is None else self.mark
        # Longer steps while one token does not end, so that it is not matched anew too often.
        data = self.stream.read(max(self.chunk, len(self.buf) - drop))
        if data:
            self.buf = self.buf[drop:] + data
            self.base, self.i = self.base + drop, self.i - drop
            self.mark = None if self.mark is None else 0
            self.peak = max(self.peak, len(self.buf))
        return bool(data)

    def match(self, pattern: re.Pattern) -> re.Match | None:
        while True:
            m = pattern.match(self.buf, self.i)
            if m and m.end() < len(self.buf) or not self.more():
                break
        m = pattern.match(self.buf, self.i)
        if m:
            self.i = m.end()
        return m

    @property
    def at(self) -> int:
        return self.base + self.i

    def peek(self) -> bytes:
        self.match(BLANK)
        return self.buf[self.i : self.i + 1]

    def take(self, *wanted: bytes) -> bytes:
        c = self.peek()
        if c not in wanted:
            raise ValueError(f"{c!r} at byte {self.at} where one of {wanted} belongs: not an evaluation document, or the record key occurs inside records as well")
        self.i += 1
        return c

    def skip(self) -> None:
        """Pass a value."""
        c = self.peek()
        if c in b"{[" and c:
            self.i += 1
            self.leave()
        elif not self.match(STRING if c == b'"' else SCALAR):
            raise ValueError(f"no value at byte {self.at}")

    def leave(self, depth: int = 1) -> None:
        """Pass all up to the end of as many open brackets."""
        while depth:
            m = self.match(BRACKET)
            if not m:
                raise ValueError("the document ends inside an object")
            depth += 1 if m[1] in b"{[" else -1

    def value(self):
        self.peek()
        self.mark = self.i
        self.skip()
        text = self.buf[self.mark : self.i]
        self.mark = None
        return json.loads(text, strict=False)

    def keys(self):
        """(offset, key) for each member of an object whose bracket has been passed; the caller passes the value."""
        while self.peek() != b"}":
            if self.peek() == b",":
                self.i += 1
                self.peek()
            at = self.at
            m = self.match(STRING)
            if not m:
                raise ValueError(f"no key at byte {at}")
            key = json.loads(m[0], strict=False)
            self.take(b":")
            yield at, key
        self.i += 1


@dataclass
class Section:
    """Where a dataset's list begins, and what stands before it in the dataset."""

    at: int
    dataset: str
    head: dict


def walk(scan: Scanner, top: dict, inside: bool):
    """A ``Section`` at each list of records, and None at each record, whose body the caller then passes.

    From the document's first byte (``top`` takes up its scalars), or from inside a record (``inside``), which is passed first.
    """
    if inside:
        scan.leave()
        yield from _list(scan)
        for _, _ in scan.keys():
            scan.skip()
        yield from _datasets(scan)
        return
    scan.take(b"{")
    for _, key in scan.keys():
        if key != "datasets":
            top[key] = scan.value()
            continue
        scan.take(b"{")
        yield from _datasets(scan)


def _datasets(scan: Scanner):
    for _, name in scan.keys():
        scan.take(b"{")
        head: dict = {}
        for at, key in scan.keys():
            if key.encode() != LIST_KEY:
                head[key] = scan.value()
                continue
            scan.take(b"[")
            yield Section(at, name, head)
            yield from _list(scan)


def _list(scan: Scanner):
    while True:
        c = scan.take(b",", b"{", b"]")
        if c == b"]":
            return
        if c == b"{":
            yield None


def found(stream, pattern: re.Pattern, lo: int, hi: int, chunk: int = 4 << 20):
    """Offsets in [lo, hi) at which the pattern begins."""
    at = lo
    while at < hi:
        begin = max(0, at - 1)  # what stands before a quote matters
        stream.seek(begin)
        data = stream.read(at - begin + chunk + SLACK + 32)
        if not data:
            return
        end = min(at + chunk, hi)
        for m in pattern.finditer(data, at - begin):
            if begin + m.start() < end:
                yield begin + m.start()
        at += chunk


def last_before(stream, pattern: re.Pattern, at: int, step: int = 1 << 20) -> int | None:
    hi = at
    while hi > 0:
        lo = max(0, hi - step)
        if spots := list(found(stream, pattern, lo, hi)):
            return spots[-1]
        hi, step = lo, 2 * step
    return None


def sections_in(path: str, lo: int, hi: int, first_only: bool = False):
    """(top, Section) for the lists of records that begin in the range."""
    stream, _ = opened(path)
    top: dict = {}
    if first_only:
        yield from ((top, s) for s in [next((s for s in walk(Scanner(stream, 0, 1 << 16), top, False) if s), None)] if s)
        return
    top_known = False
    for at in found(stream, LIST, lo, hi):
        if not top_known:
            next((None for s in walk(Scanner(stream, 0, 1 << 16), top, False) if s), None)
            top_known = True
        near = last_before(stream, ANCHOR, at)
        scan = Scanner(stream, near or 0)
        for s in walk(scan, {}, near is not None):
            if s is None:
                scan.leave()
            elif s.at >= at:
                if s.at == at:
                    yield top, s
                break


def records_in(path: str, lo: int, hi: int, fields, chunk: int = 1 << 20, seen: list | None = None):
    """(offset, values) for the records that a range owns: those after the first record whose key stands at or after ``lo``, up
    to the first whose key stands at or after ``hi``; the first range owns the first record too."""
    stream, size = opened(path)
    start = 0
    if lo:
        start = next(found(stream, ANCHOR, lo, size), None)
        if start is None or start >= hi:
            return
    scan = Scanner(stream, start, chunk)
    for s in walk(scan, {}, lo > 0):
        if s is not None:
            continue
        at, anchor, made = scan.at, None, {}
        for spot, key in scan.keys():
            if key.encode() == RECORD_KEY:
                anchor = spot
            if key in fields:
                made[key] = scan.value()
            else:
                scan.skip()
        if seen is not None:
            seen.append(scan.peak)
        yield at, made
        if anchor is None:
            raise ValueError(f"a record without {RECORD_KEY.decode()} before byte {scan.at}")
        if anchor >= hi:
            return


@dataclass
class Range(InputPartition):
    path: str
    lo: int
    hi: int
    top: dict | None = None
    sections: list | None = None


@dataclass
class Ranges(InputPartition):
    """What one task reads, a range after the other."""

    parts: list


#: A source is read by so many tasks at most, or by as many more as keep a task's ranges under ``TASK_BYTES``.
TASKS, TASK_BYTES = 512, 64 << 20


def dealt(ranges: list[Range]) -> list[Ranges]:
    """Consecutive ranges for each task, so that their number follows the bytes only beyond ``TASKS`` tasks."""
    size = [r.hi - r.lo for r in ranges]
    target = min(-(-sum(size) // TASKS), TASK_BYTES)
    out, held = [], target
    for r, n in zip(ranges, size, strict=True):
        if held >= target:
            out.append(Ranges([]))
            held = 0
        out[-1].parts.append(r)
        held += n
    return out


class EvalDocuments(DataSource):
    """``eval_document``: rows of one kind (option ``part``: sections, headers or records) of the files that the JSON file ``manifest``
    lists. Options travel with every task, so the list is no option."""

    @classmethod
    def name(cls) -> str:
        return "eval_document"

    def schema(self) -> str:
        return RECORD if self.options.get("part") == "records" else SECTION

    def reader(self, schema) -> DataSourceReader:
        return EvalReader(dict(self.options), schema)


class EvalReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema

    def partitions(self):
        step = int(self.options["range_bytes"])
        out = []
        with opened(self.options["manifest"])[0] as stream:
            files = json.loads(stream.read())
        for f in files:
            if self.options["part"] == "headers":
                out.append(Range(f["path"], 0, 1))
            else:
                out += [Range(f["path"], lo, min(lo + step, f["size"]), f.get("top"), f.get("sections")) for lo in range(0, f["size"], step)]
        return dealt(out) or [Ranges([])]

    def read(self, task: Ranges):
        for part in task.parts:
            yield from self.read_range(part)

    def read_range(self, part: Range):
        if self.options["part"] != "records":
            for top, s in sections_in(part.path, part.lo, part.hi, self.options["part"] == "headers"):
                head = s.head
                yield (part.path, s.at, top.get("label"), top.get("ckpt_path"), top.get("n_rollouts"), s.dataset, head.get("n_prompts"), {k: float(v) for k, v in (head.get("pass_at_k") or {}).items()}, head.get("mean_reward_at_1"))
            return
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        names = set(self.schema.names)
        rows, held = [], 0
        for at, made in records_in(part.path, part.lo, part.hi, names):
            dataset = [name for begin, name in part.sections if begin < at][-1]
            rows.append({**part.top, "dataset": dataset, **made})
            held += sum(map(len, made.get("rollouts") or ())) + 1000
            if held > 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def _files(spark: SparkSession, path: str) -> list[dict]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found_ = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []
    return [{"path": f.getPath().toString(), "size": f.getLen()} for f in found_ if f.isFile()]


def _load(spark: SparkSession, part: str, files: list[dict], range_bytes: int, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(EvalDocuments)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(shared_path(spark, "manifest"))
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    stream = fs.create(at)
    stream.write(json.dumps(files).encode())
    stream.close()
    reader = spark.read.format("eval_document").options(part=part, manifest=fs.makeQualified(at).toString(), range_bytes=str(range_bytes))
    return (reader.schema(_parse_datatype_string(schema)) if schema else reader).load()


def read_eval_headers(spark: SparkSession, path: str, all_datasets: bool = True, range_bytes: int = 128 << 20) -> DataFrame:
    """A row per dataset of the documents that match ``path``: path, at, label, ckpt_path, n_rollouts, dataset, n_prompts, pass_at_k,
    mean_reward_at_1.

    With ``all_datasets`` each range is searched for the lists' keys and only what stands before a list is parsed. Without, a
    document's first dataset is read and nothing after the beginning of its list.
    """
    return _load(spark, "sections" if all_datasets else "headers", _files(spark, path), range_bytes)


def read_eval_document(spark: SparkSession, path: str, fields=("problem_id", "ground_truth", "n_correct", "rewards", "preds", "rollouts"), range_bytes: int = 128 << 20) -> DataFrame:
    """A row per prompt of the documents that match ``path``, with the document's scalars, the dataset and ``fields``.

    Two passes: the first finds where datasets begin (a row per dataset comes to the driver, like a file's footer), the second
    reads records, a task per ``range_bytes``. A record must have a key ``problem_id``, which no object inside it has. Control
    characters in strings are let through, as the writers of such documents do not escape them all.
    """
    files = _files(spark, path)
    by: dict[str, list] = {}
    for r in _load(spark, "sections", files, range_bytes).select("path", "at", "dataset", "label", "ckpt_path", "n_rollouts").collect():
        by.setdefault(r.path, []).append(r)
    for f in files:
        rows = sorted(by.get(f["path"], ()), key=lambda r: r.at)
        f["sections"] = [[r.at, r.dataset] for r in rows]
        f["top"] = {c: rows[0][c] for c in ("label", "ckpt_path", "n_rollouts")} if rows else {}
    files = [f for f in files if f["sections"]]
    kinds = {f.name: f.dataType.simpleString() for f in _parse_datatype_string(RECORD).fields}
    names = [*TOP_NAMES, "dataset", *fields]
    return _load(spark, "records", files, range_bytes, ", ".join(f"{n} {kinds[n]}" for n in names))


TOP_NAMES = ("label", "ckpt_path", "n_rollouts")


def flatten_records(records: DataFrame, arm: str = "label") -> DataFrame:
    """Records to a row per (arm, dataset, problem, rollout)."""
    each = F.posexplode(F.arrays_zip("rewards", "preds", "rollouts")).alias("rollout_idx", "r")
    return records.select(F.col(arm).alias("arm"), "dataset", "problem_id", F.col("ground_truth").alias("gold"), each).select(
        "arm", "dataset", "problem_id", "gold", "rollout_idx", F.col("r.rewards").alias("reward"), F.col("r.preds").alias("pred"), F.col("r.rollouts").alias("completion")
    )
