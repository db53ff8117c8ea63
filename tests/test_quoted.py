"""Quoted CSV read in many splits against the csv module over whole files, and folders of files with headers of their own."""

import csv
import io
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from webgrain.sources import exports, quoted

SEARCH = (exports.SEARCH_DIMENSIONS, exports.SEARCH_METRICS)
FIELDS = [*SEARCH[0], *SEARCH[1]]


@given(st.text(alphabet='a,"\n ', max_size=40))
@settings(max_examples=600, deadline=None)
def test_lines_are_open_as_the_csv_module_has_it(text):
    records, held = [], []
    inside = False
    for line in text.split("\n"):
        inside = quoted.ends_inside(line, inside)
        held.append(line)
        if not inside:
            records, held = [*records, "\n".join(held)], []
    if held:
        records.append("\n".join(held))
    want = list(csv.reader(io.StringIO(text)))
    assert [r for r in quoted.parsed(records) if r] == [r for r in want if r]


def plain(text, name):
    """Data rows by the csv module, in fields of the first header."""
    rows = [r for r in csv.reader(io.StringIO(text.replace("\r\n", "\n"))) if any(c.strip() for c in r)]
    known = [{s for v in x.values() for s in v} for x in SEARCH]
    at = next((i for i, r in enumerate(rows) if quoted.is_header(r, *known)), None)
    return [] if at is None else [(name, *r.values()) for r in quoted.by_header(rows[at + 1 :], rows[at], {**SEARCH[0], **SEARCH[1]}) if r]


def read(spark, path):
    rows = quoted.read_quoted(spark, path, *SEARCH).collect()
    return [(r["file"].rsplit("/", 1)[1], *[r[f] for f in FIELDS]) for r in sorted(rows, key=lambda r: (r["file"], r["block"], r["line"]))]


def written(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


def cells(rng, n):
    bits = ["shoe", ' "red" ', "a,b", "two\nlines", "x\n\n\"\"\n,y", "", 'in"ch', "é中", "Clicks,Query\nPage"]
    return [["".join(rng.choices(bits, k=rng.randrange(3))), f"/p{i}", str(i), "1,000", "0.5%", "2.5"] for i in range(n)]


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_a_file_in_many_splits_equals_the_csv_module(spark, small_splits, tmp_path):
    rng = random.Random(8)
    rows = [["# made", 'by "us"'], ["note\nClicks,Query"], [], ["Top queries", "Top pages", "Clicks", "Impressions", "CTR", "Position"], *cells(rng, 300)]
    rows.insert(150, ["long", "one\n" * 900, "1", "2", "", ""])  # a cell over many splits
    text = written(rows) + 'tail,/t,"1\nnever closed,2'
    (tmp_path / "big.csv").write_text(text)
    got = read(spark, str(tmp_path / "big.csv"))
    assert got == plain(text, "big.csv") and len(got) > 290
    lines = spark.read.text(str(tmp_path / "big.csv"))
    assert lines.rdd.getNumPartitions() > 30
    whole = quoted.read_quoted(spark, str(tmp_path / "big.csv"), *SEARCH)
    assert len({r["block"] for r in whole.select("block").collect()}) > 15  # read where they lie


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_a_folder_of_files_with_their_own_headers(spark, small_splits, tmp_path, end):
    rng = random.Random(2)
    files = {
        "a.csv": [["Query", "Page", "Clicks", "Impressions", "CTR", "Position"], *cells(rng, 40)],
        "b.csv": [["x", "y"]] * 40 + [["Clicks", "IMPRESSIONS", "Top queries"]] + [["3", "4", f"q{i}"] for i in range(30)],
        "c.csv": [["no", "header"], ["1", "2"]],
        "d.csv": [],
        "e.csv": [["Date", "average position", "Clicks"], ["2024-01-02", "7", "1"], ["", " ", ""], ["2024-01-03"]],
    }
    for name, rows in files.items():
        (tmp_path / name).write_bytes(written(rows, end).encode())
    want = [r for name, rows in sorted(files.items()) for r in plain(written(rows), name)]
    assert read(spark, str(tmp_path)) == want
    assert want[-1] == ("e.csv", None, None, "2024-01-03", "", None, None, "")
    raw = exports.read_export(spark, str(tmp_path), *SEARCH).orderBy("ordinal").collect()
    assert [r["clicks"] for r in raw] == [r[4] for r in want]


def test_visits_without_a_page_are_left_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Landing page,Sessions,Users\n(not set),9,9\n/x,1,1\n,2,2\n")
    rows = exports.analytics_rows(exports.read_export(spark, str(tmp_path / "a.csv"), exports.ANALYTICS_DIMENSIONS, exports.ANALYTICS_METRICS))
    assert [(r["page"], r["sessions"]) for r in rows.collect()] == [("/x", 1.0)]
