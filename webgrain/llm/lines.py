"""Line dedup by a segment-partition edit join.

Native: DataFrame functions only. Equal lines are grouped by hash first. Each line that is left is split into threshold + 1
segments, one of which survives in any line within the threshold; lines of the same or a slightly larger length probe the
segment index with the few substrings that the lengths allow, and pairs that share one are verified by a banded
bit-parallel edit distance, 2 * threshold + 1 bits to a column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webgrain.llm.common import let, staged, text_or_empty

THRESHOLD = 2
#: Shorter lines (in code points) are not joined by edits: segments need so many, and two edits make most of such lines alike.
LEAST_CHARS = 2 * THRESHOLD + 2
#: Equal lines with a word are grouped from this length on by the query and the pipeline.
EXACT_CHARS = 1
#: Letters whose counts tell lines apart before texts are fetched: an edit changes their L1 distance by 2 at most.
LETTERS = "etainors"
#: Lines, or line numbers, up to which a table is broadcast; beyond, it is joined by shuffling.
BROADCAST_LINES = 400_000
BROADCAST_NUMBERS = 3_000_000


def segment(i: int, length: Column, threshold: int) -> tuple[Column, Column]:
    """First character and length of the i-th (from 1) of threshold + 1 segments, the longer ones last."""
    n = threshold + 1
    base, short = F.floor(length / n).cast("int"), F.lit(n) - length % n
    return F.lit(1) + base * (i - 1) + F.greatest(F.lit(i - 1) - short, F.lit(0)), base + (F.lit(i) > short).cast("int")


def index_keys(s: Column, length: Column, threshold: int) -> list[Column]:
    return [F.xxhash64(length, F.lit(i), F.substring(s, *segment(i, length, threshold))) for i in range(1, threshold + 2)]


def probe_keys(s: Column, length: Column, threshold: int) -> list[tuple[int, Column]]:
    """(less, key) of the substrings that can match a segment of a line shorter by less, 0 to threshold. A segment may be
    shifted by the edits before it, at most i - 1 of them, or after it, seen from the other end; both bounds hold."""
    keys, n = [], threshold + 1
    for less in range(n):
        shorter = length - less
        for i in range(1, n + 1):
            start, size = segment(i, shorter, threshold)
            for shift in range(max(1 - i, less - (n - i)), min(i - 1, less + (n - i)) + 1):
                keys.append((less, F.xxhash64(shorter, F.lit(i), F.substring(s, start + shift, size))))
    return keys


def letter_count(s: Column, c: str) -> Column:
    """How often an ASCII letter occurs; bytes are counted, as that needs no look at each character."""
    return F.octet_length(s) - F.octet_length(F.replace(s, F.lit(c), F.lit("")))


def letter_counts(s: Column) -> Column:
    """Counts of LETTERS modulo 16, four bits each, as one long."""
    parts = [F.shiftleft((letter_count(s, c) % 16).cast("long"), 4 * k) for k, c in enumerate(LETTERS)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def letters_apart(a: Column, b: Column) -> Column:
    """A lower bound of the L1 distance of two letter counts."""
    total = F.lit(0)
    for k in range(len(LETTERS)):
        d = F.pmod(F.shiftright(a, 4 * k).bitwiseAND(F.lit(15)) - F.shiftright(b, 4 * k).bitwiseAND(F.lit(15)), F.lit(16))
        total = total + F.least(d, 16 - d)
    return total


def bag_distance(x: Column, y: Column) -> Column:
    """L1 distance of the counts of a to z; an edit changes it by 2 at most."""
    total = F.lit(0)
    for c in "abcdefghijklmnopqrstuvwxyz":
        total = total + F.abs(letter_count(x, c) - letter_count(y, c))
    return total


def banded_distance(x: Column, y: Column, threshold: int) -> Column:
    """Edit distance of two strings whose lengths differ by at most threshold, exact up to threshold (else larger).

    Column by column of y, bit b of the words stands for row j - threshold + b of x. vp and vn mark vertical steps of +1
    and -1; the score follows the band's lower edge to x's last row, then that row to y's end.
    """
    width = 2 * threshold + 1
    full = (1 << width) - 1

    def run(xs: Column, ys: Column) -> Column:
        m = F.size(xs)

        def step(a: Column, j: Column) -> Column:
            low = j - threshold  # row of bit 0
            c = F.get(ys, j - 1)
            x = F.lit(0)
            for b in range(width):
                x = x + F.when(F.get(xs, low + (b - 1)).eqNullSafe(c), F.lit(1 << b)).otherwise(F.lit(0))

            def rest(x: Column) -> Column:
                vp, vn = a["vp"], a["vn"]
                d0 = (x.bitwiseAND(vp) + vp).bitwiseAND(F.lit(full)).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn)

                def tail(d: Column) -> Column:
                    hp = vn.bitwiseOR(F.lit(full).bitwiseXOR(d.bitwiseOR(vp)))
                    hn = d.bitwiseAND(vp)
                    shifted = F.shiftright(d, 1)
                    row = F.greatest(m - low, F.lit(0))
                    down = F.when(F.shiftright(d, 2 * threshold).bitwiseAND(F.lit(1)) == 1, 0).otherwise(1)
                    along = F.call_function("shiftright", hp, row).bitwiseAND(F.lit(1)) - F.call_function("shiftright", hn, row).bitwiseAND(F.lit(1))
                    return F.struct(
                        hn.bitwiseOR(F.lit(full).bitwiseXOR(shifted.bitwiseOR(hp))).alias("vp"),
                        shifted.bitwiseAND(hp).alias("vn"),
                        (a["s"] + F.when(j <= m - threshold, down).otherwise(along)).alias("s"),
                    )

                return let(d0, tail)

            return let(x, rest)

        start = F.struct(F.lit(((1 << (threshold + 1)) - 1) << threshold).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("s"))
        return F.aggregate(F.sequence(F.lit(1), F.size(ys)), start, step, lambda a: a["s"])

    return let(F.struct(F.split(x, "").alias("x"), F.split(y, "").alias("y")), lambda p: run(p["x"], p["y"]))


def removed_per_row(removed: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """(d, dt, gone): sorted line numbers for each row of documents, and whether they may be broadcast."""
    out = staged(
        removed.groupBy(F.col("doc_id").alias("d"), F.col("t").alias("dt")).agg(F.array_sort(F.collect_set("no")).alias("gone")), name
    )
    return out, out.agg(F.coalesce(F.sum(F.size("gone") + 2), F.lit(0))).collect()[0][0] <= BROADCAST_NUMBERS


def with_removed(docs: DataFrame, removed: DataFrame, name: str) -> DataFrame:
    gone, few = removed_per_row(removed, name)
    return docs.join(
        F.broadcast(gone) if few else gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("t") == F.col("dt")), "left"
    ).drop("d", "dt")


def dedup_lines(
    docs: DataFrame, *, threshold: int = THRESHOLD, least_chars: int = LEAST_CHARS, exact_chars: int | None = None
) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with its text less the repeated lines; n_lines and n_removed_lines appended.

    A line (between line feeds, compared as it is) of least_chars code points or more is removed if an equal line comes
    earlier, or if it is the first of its kind and another kind's first line within `threshold` edits comes earlier; the
    order is (doc_id, text hash, line), null ids last. Lines that are removed themselves still count as earlier ones.
    A shorter line of exact_chars or more (least_chars if None) is removed if it has a word and an equal line comes earlier.
    Defined results: a null text stays null with no lines, an empty one is one empty line; rows with equal id and text
    count as one and change alike; very long texts and lines are handled whole; a row may end up empty; an empty table
    gives an empty result; a column of docs named like an appended one (in either case) is replaced.
    """
    if threshold < 1 or least_chars < 2 * threshold + 2:
        raise ValueError("threshold is 1 or more, and least_chars at least 2 * threshold + 2")
    exact_chars = least_chars if exact_chars is None else exact_chars
    own = ["n_lines", "n_removed_lines"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in own])
    source = docs.select("doc_id", F.xxhash64("text").alias("t"), "text")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t", "no")

    cut = source.select("doc_id", "t", F.posexplode(F.split(text_or_empty("text"), "\n")).alias("no", "s"))
    grouped = (F.length("s") >= least_chars) | ((F.length("s") >= exact_chars) & F.col("s").rlike(r"[^\x20\x09-\x0D]"))
    hashed = cut.where(grouped).select("doc_id", "t", "no", F.xxhash64("s").alias("h"), F.xxhash64("s", F.lit("second")).alias("h2"))
    lines = staged(hashed, "lines")
    copies = staged(
        lines.groupBy("h", "h2").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "lines-copies"
    )
    exact = staged(lines.join(copies, ["h", "h2"]).where(order != F.col("first")).select("doc_id", "t", "no"), "lines-exact")

    # what is left holds each kind of line once
    once = with_removed(source, exact, "lines-exact-rows").select(
        "doc_id", "t", F.split(text_or_empty("text"), "\n").alias("all"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone")
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    firsts = once.select(
        "doc_id", "t", F.explode(F.transform(kept, lambda i: F.struct(i.alias("no"), F.get(F.col("all"), i).alias("s")))).alias("l")
    )
    firsts = firsts.select("doc_id", "t", "l.no", "l.s").where(F.length("s") >= least_chars)

    # one pass over the texts; of equally long lines one direction is enough
    sized = firsts.select("s", F.xxhash64("s").alias("h"), F.length("s").alias("n"))
    keyed = sized.select(
        "h",
        letter_counts(F.col("s")).alias("c"),
        F.array(*index_keys(F.col("s"), F.col("n"), threshold)).alias("index"),
        F.array(*[k for _, k in probe_keys(F.col("s"), F.col("n"), threshold)]).alias("probe")
    )
    keys = staged(keyed, "lines-keys")
    lesses = F.array(*[F.lit(less) for less, _ in probe_keys(F.lit(""), F.lit(1), threshold)])
    index = keys.select("h", "c", F.explode("index").alias("k"))
    probe = keys.select(F.col("h").alias("g"), F.col("c").alias("e"), F.posexplode("probe").alias("p", "k"))
    probe = probe.select("g", F.col("e").bitwiseOR(F.shiftleft(F.get(lesses, F.col("p")).cast("long"), 48)).alias("e"), "k")
    less = F.shiftright("e", 48)
    ordered = (F.col("h") != F.col("g")) & ((F.col("h") < F.col("g")) | (less > 0))
    # of at most threshold edits, `less` at least are insertions, which change one count by 1 each; the others two
    near = index.join(probe, (index["k"] == probe["k"]) & ordered & (letters_apart(F.col("c"), F.col("e")) <= 2 * threshold - less))
    pairs = staged(near.select(F.least("h", "g").alias("a"), F.greatest("h", "g").alias("b")).distinct(), "lines-pairs")

    wanted = staged(pairs.select(F.col("a").alias("w")).unionByName(pairs.select(F.col("b").alias("w"))).distinct(), "lines-wanted")
    few = wanted.count() <= BROADCAST_LINES
    texts = firsts.withColumn("h", F.xxhash64("s")).join(F.broadcast(wanted) if few else wanted, F.col("h") == F.col("w"), "left_semi")
    texts = staged(texts.select("h", order.alias("o"), "s"), "lines-texts")
    x = texts.select(F.col("h").alias("a"), F.col("o").alias("oa"), F.col("s").alias("x"))
    y = texts.select(F.col("h").alias("b"), F.col("o").alias("ob"), F.col("s").alias("y"))
    close = pairs.join(x, "a").join(y, "b").where(F.abs(F.length("x") - F.length("y")) <= threshold)
    close = close.where(
        (bag_distance(F.col("x"), F.col("y")) <= 2 * threshold) & (banded_distance(F.col("x"), F.col("y"), threshold) <= threshold)
    )
    later = close.select(F.greatest("oa", "ob").alias("o")).distinct().select("o.doc_id", "o.t", "o.no")

    whole = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text", F.xxhash64("text").alias("t")
    )  # names of docs can't clash with ours
    final = with_removed(whole, exact.unionByName(later), "lines-removed")
    every = F.split(F.col("text"), "\n")
    left = let(
        every,
        lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("gone")), lambda i: F.get(a, i)), "\n")
    )
    return final.select(
        *[F.when(F.col("gone").isNull(), F.col("text")).otherwise(left).alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns],
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(every)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"),
    )


def op1(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), exact_chars=EXACT_CHARS)
