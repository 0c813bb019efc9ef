"""Line dedup deletes every line of a later copied run, also those after its first min_chars characters."""

import random

import pytest

from gridloom.llm import lines


def whole_runs(by_doc, least):
    """Every line of any run of `least` characters or more that has an earlier copy, by trying all runs."""
    seen, out = set(), {}
    for i in sorted(by_doc):
        parts = by_doc[i].split("\n")
        gone = set()
        for s in range(len(parts)):
            for e in range(s + 1, len(parts) + 1):
                run = tuple(parts[s:e])
                if sum(map(len, run)) >= least and run in seen:
                    gone |= set(range(s, e))
                seen.add(run)
        out[i] = (len(parts), len(gone), "\n".join(x for k, x in enumerate(parts) if k not in gone))
    return out


def deduped(spark, by_doc, least):
    d = spark.createDataFrame(list(by_doc.items()), "doc_id long, text string").repartition(3)
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in lines.dedup_lines(d, min_chars=least).collect()}


def test_short_last_lines_of_a_copy_go(spark):
    a, b = "a" * 50, "b" * 10
    got = deduped(spark, {1: f"{a}\n{b}", 2: f"{a}\n{b}\nother", 3: f"{b}\n{a}\n{b}", 4: f"{b}\nnew"}, 40)
    assert got == {1: (2, 0, f"{a}\n{b}"), 2: (3, 2, "other"), 3: (3, 2, b), 4: (2, 0, f"{b}\nnew")}


@pytest.mark.parametrize("least", [40, 12])
def test_against_all_runs(spark, least):
    r = random.Random(3)
    kinds = [c * n for c, n in zip("abcdefgh", (1, 1, 2, 3, 8, 15, 30, 60), strict=True)]
    by_doc, passages = {}, [[r.choice(kinds) for _ in range(r.randint(2, 45))] for _ in range(6)]
    for k in range(40):
        have = [f"x{k}" * r.randint(1, 9)] if k % 3 else []
        for _ in range(r.randint(1, 3)):
            p = r.choice(passages)
            s = r.randrange(len(p))
            have += [*p[s : s + r.randint(1, 45)], *([f"y{k}"] if r.random() < 0.7 else [])]
        by_doc[k] = "\n".join(have)
    assert deduped(spark, by_doc, least) == whole_runs(by_doc, least)
