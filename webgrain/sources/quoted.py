"""Quoted CSV files, many and large, with line feeds in cells: split anywhere, each with a header of its own somewhere.

Spark reads the files as lines, in splits. Whether a split begins within a quoted cell depends on all lines before it, so each
split first tells how it would end from either state; these few rows, put together file by file, give every split its
state. Then each split reads its own records. Parts of a record that lies across splits are rows of their own,
which are joined again. No file is read by one task, and no line is moved but those parts.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webgrain.staging import staged

CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')
PLACE = "file string, block long, line long"


def bare(header: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", header.strip().lower())


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line, by whether one was at its beginning. Quotes within a cell that
    doesn't begin with one are plain characters."""
    at = 0
    while True:
        if inside or line[at : at + 1] == '"':
            closed = CLOSING.match(line, at if inside else at + 1)
            if closed is None:
                return True
            at, inside = closed.end(), False
        at = line.find(",", at) + 1
        if not at:
            return False


def parsed(records: list[str]) -> list[list[str]]:
    """Cells of whole records."""
    csv.field_size_limit(2**31 - 1)
    return [next(csv.reader((r,)), []) for r in records]


def is_header(cells: list[str], dimensions: set[str], metrics: set[str]) -> bool:
    names = {bare(c) for c in cells}
    return bool(names & dimensions and names & metrics)


def runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch (file, block, ...) that belong to one split each, in order."""
    if not batch.num_rows:
        return
    names, block = batch.column(0).dictionary_encode(), batch.column(1).to_numpy()
    file = names.indices.to_numpy()
    edges = [0, *(np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield (names.dictionary[int(file[a])].as_py(), int(block[a])), batch.slice(a, b - a)


STATES = "file string, block long, ends array<boolean>, head_lines array<long>, heads array<string>"


def _ends(dimensions: set[str], metrics: set[str]):
    """Of each split, for either state at its beginning: its state at the end, and its first header with its line."""
    spelled = "|".join("[^a-z0-9]*".join(m) for m in sorted(metrics))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, head, line = None, [False, True], [None, None], 0

        def told() -> pa.RecordBatch:
            lines, texts = [h and h[0] for h in head], [h and h[1] for h in head]
            columns = [pa.array([v], t) for v, t in (
                (split[0], pa.string()), (split[1], pa.int64()), (state, pa.list_(pa.bool_())),
                (lines, pa.list_(pa.int64())), (texts, pa.list_(pa.string())),
            )]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in STATES.split(", ")])

        for batch in batches:
            for at, part in runs(batch):
                if at != split:
                    if split is not None:
                        yield told()
                    split, state, head, line = at, [False, True], [None, None], 0
                text = part.column(2)
                quoted = pc.match_substring(text, '"').to_numpy(zero_copy_only=False)
                named = quoted | False
                if None in head:
                    named = quoted | pc.match_substring_regex(text, spelled, ignore_case=True).to_numpy(zero_copy_only=False)
                for i in np.flatnonzero(named):
                    value = text[int(i)].as_py()
                    if None in head and (not quoted[i] or not ends_inside(value, False)):
                        if is_header(parsed([value])[0], dimensions, metrics):
                            head = [h or (None if s else (line + int(i), value)) for h, s in zip(head, state, strict=True)]
                    if quoted[i]:
                        state = [ends_inside(value, s) for s in state] if state[0] != state[1] else [ends_inside(value, state[0])] * 2
                line += part.num_rows
        if split is not None:
            yield told()

    return scan


SPLITS = "file string, block long, starts_inside boolean, ends_inside boolean, head_block long, head_line long, head string"


def _resolved(splits: pd.DataFrame) -> pd.DataFrame:
    """A file's splits in order, each with its state, and the file's first header."""
    splits = splits.sort_values("block")
    state, rows, head = False, [], (None, None, None)
    for s in splits.itertuples(index=False):
        if head[2] is None and s.heads[int(state)] is not None:
            head = (s.block, int(s.head_lines[int(state)]), s.heads[int(state)])
        end = bool(s.ends[int(state)])
        rows.append((s.file, s.block, state, end))
        state = end
    out = pd.DataFrame([(*r, *head) for r in rows], columns=[c.split()[0] for c in SPLITS.split(", ")])
    return out.astype({"head_block": "Int64", "head_line": "Int64"})


def _records(fields: dict[str, tuple[str, ...]], parts: bool):
    """Rows of the records that begin and end in one split, after the header; or, with parts, the parts of other records."""
    shape = pa.schema([
        ("file", pa.string()), ("block", pa.int64()), ("line", pa.int64()),
        *([("opens", pa.bool_()), ("text", pa.string())] if parts else [(c, pa.string()) for c in fields]),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, head, inside, first, held, line = None, None, False, True, [], 0

        def part(opens: bool) -> pa.RecordBatch:
            row = (*split, line if not held else held[0][0], opens, "\n".join(t for _, t in held))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, shape, strict=True)], schema=shape)

        for batch in batches:
            for at, own in runs(batch):
                if at != split:
                    if split is not None and parts and held:
                        yield part(not first)
                    row = own.slice(0, 1).to_pylist()[0]
                    split, inside, held, line = at, row["starts_inside"], [], 0
                    first = inside  # what comes first belongs to a record of an earlier split
                    head = (row["head_block"], row["head_line"], row["head"])
                texts = own.column(2).to_pylist()
                found: list[tuple[int, str]] = []
                for i, text in enumerate(texts):
                    if '"' in text:
                        inside = ends_inside(text, inside)
                    if inside or held or first:
                        held.append((line + i, text))
                        if inside:
                            continue
                        if first:
                            if parts:
                                yield part(False)
                        else:
                            found.append((held[0][0], "\n".join(t for _, t in held)))
                        first, held = False, []
                    else:
                        found.append((line + i, text))
                line += len(texts)
                if not parts and head[2] is not None:
                    found = [(n, t) for n, t in found if (split[1], n) > head[:2]]
                    rows = by_header(parsed([t for _, t in found]), parsed([head[2]])[0], fields)
                    kept = [i for i, r in enumerate(rows) if r is not None]
                    n = len(kept)
                    columns = [[split[0]] * n, [split[1]] * n, [found[i][0] for i in kept], *([rows[i][c] for i in kept] for c in fields)]
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, shape, strict=True)], schema=shape)
        if split is not None and parts and held:
            yield part(not first)

    return read


def by_header(rows: list[list[str]], header: list[str], fields: dict[str, tuple[str, ...]]) -> list[dict[str, str | None] | None]:
    """Rows as fields by the spellings of the header; None for blank rows. A field that the header lacks is null."""
    names = [bare(c) for c in header]
    at = {f: next((names.index(s) for s in spellings if s in names), None) for f, spellings in fields.items()}
    width = len(header)
    out = []
    for r in rows:
        if not any(c.strip() for c in r[:width]):
            out.append(None)
        else:
            out.append({f: None if i is None else r[i].strip() if i < len(r) else "" for f, i in at.items()})
    return out


def read_quoted(spark: SparkSession, path: str, dimensions: dict, metrics: dict) -> DataFrame:
    """(file, block, line, fields): the data rows of quoted CSV files (a file, a folder or a pattern) as strings.

    Each file's header is its first record in one line with a known dimension and a known metric; what comes before is left out,
    a file without one has no rows. Fields are found by each file's own header; those it lacks are null. Line ends
    within cells become line feeds; a quoted cell that is never closed ends with its file; blank rows are left out. block and
    line give a record's place in its file.
    Broadcast is a row for each split of the files, so one for some 128 MB of input.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )
    names = [{s for v in x.values() for s in v} for x in (dimensions, metrics)]
    fields = {**dimensions, **metrics}
    scanned = lines.mapInArrow(_ends(*names), STATES)
    splits = staged(scanned.groupBy("file").applyInPandas(_resolved, SPLITS), "quoted-splits")
    shape = PLACE + ", " + ", ".join(f"{c} string" for c in fields)
    columns = ["file", "block", "value", "starts_inside", "head_block", "head_line", "head"]
    placed = lines.join(F.broadcast(splits), ["file", "block"]).select(columns)
    whole = placed.mapInArrow(_records(fields, False), shape)
    cut = splits.where("starts_inside OR ends_inside")
    if cut.isEmpty():
        return whole
    some = lines.join(F.broadcast(cut), ["file", "block"]).select(columns)
    parts = some.mapInArrow(_records(fields, True), PLACE + ", opens boolean, text string")
    order = Window.partitionBy("file").orderBy("block", "opens")  # at most two parts of a split
    grouped = parts.withColumn("record", F.sum(F.col("opens").cast("int")).over(order))
    joined = grouped.groupBy("file", "record").agg(
        F.min_by(F.struct("block", "line"), F.struct(~F.col("opens"), "block")).alias("at"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "opens", "text"))), lambda x: x["text"]), "\n").alias("text"),
    )
    heads = splits.where("head IS NOT NULL").select("file", "head_block", "head_line", "head").distinct()
    after = F.struct("at.block", "at.line") > F.struct(F.col("head_block").alias("block"), F.col("head_line").alias("line"))
    told = joined.join(F.broadcast(heads), "file").where(after).select("file", "at.block", "at.line", "text", "head")

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [by_header(parsed([t]), parsed([h])[0], fields)[0] for t, h in zip(f["text"], f["head"], strict=True)]
            kept = [r is not None for r in rows]
            out = pd.DataFrame([r for r in rows if r is not None], columns=list(fields), dtype=object)
            yield pd.concat([f.loc[kept, ["file", "block", "line"]].reset_index(drop=True), out], axis=1)

    return whole.unionByName(told.mapInPandas(cells, shape))
