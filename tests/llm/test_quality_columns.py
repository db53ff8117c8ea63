"""Base columns of op2 over odd texts, and that none is made by replacing a whole text's characters one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from webgrain.llm import quality

TEXTS = [
    None, "", " \t\r\n", "#", "a#b*$ %&|<> ^]-", "\x0b\n \n\x0c\nx\n x\nx\nx ", " \n \n ", "😀 é\n😀 é\n\n\n", "&&[&&]<<>>\\", " lead and trail \r\n lead and trail \r\n",
]


def expected(text: str | None) -> tuple[int, int, int, int]:
    ws, text = " \t\n\x0b\x0c\r", text or ""
    words = [w for w in "".join(" " if c in ws else c for c in text).split(" ") if w]
    lines = [s for s in text.split("\n") if s.strip(ws)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines))


def test_base_columns(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    made = df.select("doc_id", quality.base_columns(F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")
    got = {r["doc_id"]: tuple(r)[1:5] for r in made.collect()}
    assert got == {i: expected(t) for i, t in enumerate(TEXTS)}
    assert "translate(" not in made._jdf.queryExecution().optimizedPlan().toString()
