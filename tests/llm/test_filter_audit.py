"""The filter audit against applying every order of the filters to the documents, and its defined results on odd input."""

import re
from itertools import permutations

from webgrain.llm import filter_audit

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, mask string, n string"
LABELS = "doc_id long, quality int, toxic int, good string"


def failing(rows):
    """Filters that each row (id, text) fails, by the plain reading of their conditions."""
    out = []
    for i, text in rows:
        t = text or ""
        words, fails = re.findall(r"[^\x20\x09-\x0D]+", t), set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 2 * len(t):
            fails.add("C")
        if set(t) & set("#$%&*|"):
            fails.add("D")
        if i is not None and any(j is not None and j < i and (u or "") == t for j, u in rows):
            fails.add("E")
        out.append(fails)
    return out


def by_hand(docs, labels):
    fails = failing([(i, t) for i, t, _ in docs])
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, x in labels if x == 1}
    out = {}
    for part in {s or "" for _, _, s in docs}:
        mine = [(i, f) for (i, _, s), f in zip(docs, fails, strict=True) if (s or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [(i, f) for i, f in left if name in f]
                kept = [(i, f) for i, f in left if name not in f]
                n = sum(name in f for _, f in mine)
                out[part, "".join(order), step] = [
                    len(kept), len(gone), n - len(gone), sum(f == {name} for _, f in mine),
                    sum(i in good and i is not None for i, _ in gone), sum(i in toxic and i is not None for i, _ in gone),
                ]
                shapley[name] += len(gone)
                left = kept
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def as_table(frame):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    rows = frame.collect()
    table = {(r["part"], r["filter_order"], r["step"]): [r[n] for n in names] for r in rows}
    assert len(table) == len(rows)
    return table


def test_audit_against_every_order(spark):
    docs = [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert as_table(filter_audit.op12(spark, SF)) == by_hand(docs, labels)


def test_audit_against_sql(same_as_sql):
    same_as_sql(filter_audit.op12, filter_audit.ORACLE_OP12)


ODD = [
    (1, None, None), (2, "", "a"), (2, "", "a"), (3, " \n\t ", "a"), (None, "word " * 300, "b"), (5, "word " * 300, "b"),
    (5, "word " * 300, "a"), (6, "word " * 300, None), (7, "A" * 60_000, "b"), (8, " ".join(f"w{i}" for i in range(40_000)), "b"),
    (None, None, ""), (9, "100 % é \U0001f600", "b"), (None, "word " * 300, "b"),
]


def test_audit_of_odd_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(*r, "own", "own") for r in ODD], DOCS)
    labels = [(5, 1, 0), (5, 0, 1), (5, 1, None), (None, 1, 1), (9, None, 1), (77, 1, 1), (1, 1, 0)]
    known = spark.createDataFrame([(*r, "own") for r in labels], LABELS)
    want = by_hand(ODD, labels)
    assert as_table(filter_audit.filter_audit(docs, known)) == want
    monkeypatch.setattr(filter_audit, "BROADCAST_LABELS", 0)
    assert as_table(filter_audit.filter_audit(docs.repartition(5), known)) == want
    assert filter_audit.filter_audit(docs.limit(0), known).count() == 0
    assert as_table(filter_audit.filter_audit(docs, known.limit(0))) == by_hand(ODD, [])


def test_joint_failures_are_those_of_all_32_sets(spark):
    docs = spark.createDataFrame([(*r, "own", "own") for r in ODD], DOCS)
    known = spark.createDataFrame([], LABELS)
    got = {r["part"]: r["joint"] for r in filter_audit.joint_failures(filter_audit.document_failures(docs, known)).collect()}
    fails = failing([(i, t) for i, t, _ in ODD])
    for part, joint in got.items():
        mine = [f for (_, _, s), f in zip(ODD, fails, strict=True) if (s or "") == part]
        assert [x["s"] for x in joint] == list(range(32))
        for x in joint:
            chosen = {n for i, n in enumerate("ABCDE") if x["s"] >> i & 1}
            assert x["n"] == sum(chosen <= f for f in mine)
