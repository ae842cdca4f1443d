"""Repetition alone takes a long document out of its group; one repeated line leaves a short one in."""

import random

from cartograph.llm import quality


def test_repetition_alone_rejects(spark):
    rnd = random.Random(6)

    def line(n):
        return " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(3, 8))) for _ in range(n))

    rows = [(i, "\n".join(line(rnd.randint(8, 14)) for _ in range(rnd.randint(20, 90)))) for i in range(120)]
    own, short = [line(50) for _ in range(6)], [line(12) for _ in range(6)]
    rows.append((1000, "\n".join(own + ["read more here"] * 98)))
    rows.append((1001, "\n".join([*short, short[2]])))
    docs = spark.createDataFrame([(d, t, "en", "s") for d, t in rows], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    assert not got[1000].base_failed and not got[1000].kept, got[1000]
    assert got[1001].kept and sum(got[i].kept for i in range(120)) >= 118
