"""Base counts and the Jensen-Shannon verdict of the quality rules against plain Python."""

import math
import random
import re
from collections import Counter

from weftline.llm import quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LIMITS = quality_rules.Limits()


def documents():
    rng = random.Random(9)
    english = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(60)]
    other = ["".join(rng.choices("klmnopqrst", k=rng.randint(2, 7))) for _ in range(60)]
    rows = []
    for i in range(60):
        words = rng.choices(english if i % 2 else other, k=rng.randint(55, 90))
        rows.append((i, " ".join(w.capitalize() if rng.random() < 0.2 else w for w in words) + ".\n", "en" if i % 2 else "xx"))
    rows.append((60, " ".join(rng.choices(english, k=30) + ["zz%d" % k for k in range(40)]), "en"))
    rows.append((61, " ".join("#$%|<>&*" + str(k) for k in range(70)), "xx"))
    rows.append((62, " ".join("qqq%d" % k for k in range(70)), "en"))
    rows.append((63, " ".join(rng.choices(english, k=80)), "rare"))
    rows.append((64, "a line\na line\n \na line \nb\na line", "en"))
    rows.append((65, None, None))
    return rows


def kind(c):
    for k, chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r\v\f", ".,;:!?'\"-()")):
        if c in chars:
            return k
    return 6 if 33 <= ord(c) < 127 else 7 if ord(c) > 127 else 8


def share(counts, keys):
    total = sum(counts[k] for k in keys)
    return [counts[k] / total if total else 0.0 for k in keys]


def distance(p, q):
    kl = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b) if x > 0)
    return math.sqrt(max(0.0, (kl(p, q) + kl(q, p)) / 2))


def test_counts_and_verdict(spark):
    rows = documents()
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)).collect()}
    classes, words, docs = {}, {}, Counter()
    for _, text, lang in rows:
        found = WORD.findall(text or "")
        classes.setdefault(lang, Counter()).update(map(kind, text or ""))
        words.setdefault(lang, Counter()).update(w.lower() for w in found)
        docs[lang] += len(found) >= LIMITS.word_min_words
    # Few of the words are beyond the common ones, and those are the once-seen: ties do not matter here.
    refs = {x: (classes[x], dict(words[x].most_common(60))) for x in classes if docs[x] >= LIMITS.reference_min_docs}
    assert set(refs) == {"en", "xx"}
    for i, text, lang in rows:
        found, r = WORD.findall(text or ""), got[i]
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        windows = Counter(tuple(found[k : k + 3]) for k in range(len(found) - 2))
        repeated = {k + j for k in range(len(found) - 2) if windows[tuple(found[k : k + 3])] > 1 for j in range(3)}
        failed = len(found) < 50 or 2 * len(repeated) > len(found)
        far = False
        if lang in refs and len(text) >= LIMITS.class_min_chars:
            near = min(distance(share(Counter(map(kind, text)), range(9)), share(c, range(9))) for c, _ in refs.values())
            assert math.isclose(r["class_distance"], near, abs_tol=1e-9)
            far |= near > LIMITS.class_distance
        else:
            assert r["class_distance"] is None
        assert (r["word_distance"] is None) == (lang not in refs or len(found) < LIMITS.word_min_words)
        if r["word_distance"] is not None:
            far |= r["word_distance"] > LIMITS.word_distance + LIMITS.word_slack / len(found)
        assert (r["base_failed"], r["kept"]) == (failed, not failed and not far)
    assert got[62]["word_distance"] > 0.9 and not got[62]["kept"] and not got[61]["kept"] and got[63]["kept"] and got[1]["kept"]
