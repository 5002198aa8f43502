"""Fuzzy line dedup on short lines and on lines with one or two edits."""

import random

from weftline.llm import line_dedup

RULES = ["-" * 9, "-" * 10, "=" * 8, "=" * 11, "abcdefghijk", "abcdefghijkl", "unlike all", "-" * 3, "=" * 4]


def removed(spark, lines, **how):
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "doc_id bigint, text string").repartition(2)
    return {r["doc_id"] for r in line_dedup.line_dedup(docs, **how).collect() if r["n_removed"]}


def test_short_lines(spark):
    size = line_dedup.SHINGLE
    sets = [{x[i : i + size] for i in range(len(x) - size + 1)} for x in RULES]
    alike = {b for b in range(len(RULES)) for a in range(b) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert removed(spark, RULES) == alike and {1, 3, 5} <= alike


def test_one_and_two_edits(spark):
    one = "posted on 12 march 2021 by the editors of the weekly paper"
    two = "all rights are reserved by the makers of this page and by those who gave their words and pictures to it, 2019 edition"
    lines = [one, one.replace("12", "17"), two, two.replace("makers", "mokers").replace("pictures", "pixtures"), "nothing like the other lines of this small table"]
    assert removed(spark, lines) == {1, 3}


def test_lines_that_meet_by_chance_are_not_read_again(spark, monkeypatch):
    """Lines of a few syllables share bands though they are unlike; before, all of them had their texts read and shuffled."""
    rng = random.Random(3)
    syllables = ["the", "tion", "er", "an", "ou", "ing", "ha", "st", "nd", "re"]
    lines = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(50)) for _ in range(600)]
    lines += [x[:100] + "q" + x[101:] for x in lines[:5]]
    sizes, write = {}, line_dedup.written

    def written(df, name="step", **how):
        out = write(df, name, **how)
        sizes[name] = out.select("number" if name == "buckets" else "*").distinct().count() if name in ("buckets", "candidates") else 0
        return out

    monkeypatch.setattr(line_dedup, "written", written)
    assert removed(spark, lines) == set(range(600, 605))
    assert sizes["buckets"] > 100 and sizes["candidates"] < sizes["buckets"] / 2
