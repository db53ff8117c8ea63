"""Secret scans: fixed patterns, and an assignment-aware lexer that follows constants to sensitive names.

The lexer (`assignments.py`) pairs names with literals in source and configuration syntax; here names and whole values are
scored. Texts go through Arrow batches; each row is scanned on its own, so nothing is shuffled and memory is one batch.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webgrain.llm.assignments import CREDENTIAL, NAME_WEIGHTS, Site, name_weight, passphrase, resolve, sites_of
from webgrain.llm.common import bounded_batches, dealt

#: Fixed patterns of the base scan and the shortest group or match that counts.
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX with 24 characters or more: a run is maximal, so both find the same
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "named")

#: A literal counts when its name's weight and its own shape reach this.
LEAST_SCORE = 3.5
#: What is asked for beyond that where the name stands in a run of words.
PROSE = 1.0
#: Texts without any of these have no name of weight.
SENSITIVE = re.compile("|".join(w for w, x in NAME_WEIGHTS.items() if x > 0), re.I)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base scan; each kind leftmost and non-overlapping."""
    found = [
        (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST
    ] if ":" in text or "=" in text else []
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    return found + [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]


def shape_score(chars: Counter, odd: int) -> float:
    """0 for plain words and numbers, texts with white space, or one kind of character unless it looks drawn at random; up to 3
    for long, mixed, high-entropy ones. chars: how often each character occurs; odd: how irregular the text is."""
    n = sum(chars.values())
    if not n or not odd or any(c.isspace() for c in chars):
        return 0.0
    kinds = any(c.isdigit() for c in chars) + any(c.islower() for c in chars) + any(c.isupper() for c in chars)
    if kinds < 2 and odd < 2:
        return 0.0
    entropy = -sum(k / n * math.log2(k / n) for k in chars.values())
    return min(1.0, n / 20) + min(1.0, entropy / 4) + (kinds - 1) / 2


def site_weight(site: Site) -> float:
    """Weight of a site's name, and of the heaviest name around it unless its own speaks against."""
    own = name_weight(site.name)
    return own if own < 0 else own + max([0.0, *map(name_weight, site.around)])


def counts(site: Site, shape: float) -> bool:
    """Whether a site's name and the shape of its whole value make it a secret. Of a choice the alternatives count, each by
    itself."""
    if site.choice:
        return False
    if shape > 0:
        weight = site_weight(site)
        return weight > 0 and weight + shape >= LEAST_SCORE + PROSE * site.prose
    only = site.parts[0]
    return len(site.parts) == 1 and only.name is None and " " in only.text and passphrase(site.name, only.text)


def named_spans(text: str) -> list[tuple[int, int, int]]:
    """Literals of sites whose name, and whole value, make them secrets: those in the value itself and, by references of
    any number, those that it is made of. A name's reference may stand before or after what binds it."""
    sites = sites_of(text)
    chars, odd = resolve(sites)
    shape = [shape_score(c, o) for c, o in zip(chars, odd, strict=True)]
    todo = [i for i, s in enumerate(sites) if counts(s, shape[i])]
    found, seen = set(), set(todo)
    while todo:
        site = sites[todo.pop()]
        found.update((p.start, 3, p.end) for p in site.parts if p.name is None)
        new = {j for j in site.links if not site.choice or shape[j] > 0} - seen
        seen |= new
        todo += new
    return list(found)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_text(text: str | None) -> tuple[int, int, int, str, str, int]:
    """n_assign, n_access, n_hex, base_sha256, spans, n_named of one whole text."""
    text = text or ""
    base = base_spans(text)
    named = named_spans(text) if SENSITIVE.search(text) or CREDENTIAL.search(text) else []
    n = Counter(k for _, k, _ in base)
    line = joined(base)
    return n[0], n[1], n[2], hashlib.sha256(line.encode()).hexdigest(), joined(base + named) if named else line, len(named)


ADDED = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in ADDED.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        rows = [scan_text(t) for t in b.column(b.num_columns - 1).to_pylist()]
        cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        keep = range(b.num_columns - 1)
        yield pa.RecordBatch.from_arrays(
            [b.column(i) for i in keep] + [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=[b.schema.field(i).name for i in keep] + names
        )


def secret_scan(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each row of docs: the columns of keep, then counts, the base digest and all spans (code points).

    Defined results: null and empty texts have no spans and the digest of the empty string; a very long text is scanned
    whole; repeated rows give repeated results; null ids pass through; an empty table gives an empty result; columns of
    docs outside keep are left out, so none can clash.
    """
    bounded_batches(docs.sparkSession)
    schema = ", ".join(f"`{c}` {docs.select(F.col(f'`{c}`')).dtypes[0][1]}" for c in keep)
    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(_batches, f"{schema}, {ADDED}")


def op10(spark, sf_dir: str) -> DataFrame:
    return secret_scan(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet")))
