"""Quality rules on a corpus of many languages."""

import random

from test_operators import SCHEMA
from weftline.llm import quality_rules


def test_every_language_of_some_size_has_a_reference(spark):
    rng = random.Random(4)
    rows = []
    for lang in range(70):
        words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(60)]
        for _ in range(25 + (lang < 40)):
            text = " ".join(rng.choices(words, k=120))
            rows.append((len(rows), text, f"l{lang}", "s", len(text), ""))
    clean = len(rows)
    for lang in ("junk", None):  # a label that one document alone carries is no reference
        text = " ".join("%$#@" for _ in range(30)) + " " + " ".join(f"{n}|{n * n}" for n in range(200))
        rows.append((len(rows), text, lang, "s", len(text), ""))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert all(got[i]["kept"] and got[i]["word_distance"] < 0.75 for i in range(clean))
    assert all(got[i]["class_distance"] is None and got[i]["word_distance"] is None for i in range(clean, len(rows)))
