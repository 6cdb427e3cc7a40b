"""Terms of whole documents: far from the entity, short names, every occurrence."""

import random

from spliceflow.llm import pii


def test_pii_terms_of_whole_documents(spark):
    rng = random.Random(7)
    fill = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(i, f"zebulon {fill(40)} zeb@ship.org {fill(40)} Bo {fill(40)} zebulon kim") for i in range(8)]
    rows += [(100 + i, f"{fill(40)}") for i in range(60)] + [(None, "zeb@ship.org zebulon"), (300, "zebulon alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    for i in range(8):
        assert clean[i].startswith("<TERM> ") and clean[i].endswith(" <TERM> <TERM>") and " <TERM> " in clean[i][10:-20]
        assert "Bo" not in clean[i] and "<EMAIL>" in clean[i]
    assert clean[None] == "<EMAIL> <TERM>" and clean[300] == "zebulon alone"
    assert all(clean[100 + i] == rows[8 + i][1] for i in range(60))
