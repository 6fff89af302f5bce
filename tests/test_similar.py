"""The similarity join against comparing all with all."""

import random

import pytest

from colloquy.functions.text import bigrams
from colloquy.operators import similar
from pyspark.sql import functions as F


def grams(label):
    t = "".join(c for c in (label or "").lower() if c not in " 。，、；：！？「」.,!?;:'\"-()")
    return {t[i : i + 2] for i in range(max(1, len(t) - 1))} if t else set()


def share(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


@pytest.mark.parametrize("least", [0.5, 0.8, 1 / 3, 1.0])
def test_no_pair_is_lost(spark, least):
    """Labels that differ by a few characters, very long ones, single characters, a job of half of all rows, hot bigrams."""
    rng = random.Random(int(least * 100))
    base = ["".join(rng.choice("abcdefg 會議預算") for _ in range(rng.choice([1, 2, 5, 12, 60]))) for _ in range(40)]

    def label():
        s = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            s.insert(rng.randint(0, len(s)), rng.choice("abxyz!預"))
        return rng.choice(["", "aa" * 30, None]) if rng.random() < 0.1 else "".join(s).upper() if rng.random() < 0.2 else "".join(s)

    make = lambda n: [(rng.choice([7, 7, 7, 1, 2, None]), i % (n - 5), label(), "x") for i in range(n)]
    left, right = make(150), make(120)
    schema = "job long, id long, label string, similarity string"
    a, b = spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)
    want = sorted((str(p[0]), p[1], q[1], round(s, 9)) for p in left for q in right if p[0] == q[0] and (s := share(grams(p[2]), grams(q[2]))) >= least)
    got = sorted((str(r["job"]), r["a"], r["b"], round(r["similarity"], 9)) for r in similar.similar(a, b, "job", least).collect())
    assert got == want and len(want) > 10
    held = {(str(p[0]), p[1]) for p in left if any(p[0] == q[0] and share(grams(p[2]), grams(q[2])) >= least for q in right)}
    lost = similar.unmatched(a, b, "job", least).collect()
    assert sorted((str(r["job"]), r["id"]) for r in lost) == sorted((str(p[0]), p[1]) for p in left if (str(p[0]), p[1]) not in held)


def test_of_nothing(spark):
    a = spark.createDataFrame([(1, 1, "label")], "job long, id long, label string")
    assert similar.similar(a.limit(0), a, "job").count() == similar.similar(a, a.limit(0), "job").count() == 0
    assert similar.unmatched(a, a.limit(0), "job").count() == 1
    assert set(a.select(bigrams(F.lit("abab"))).first()[0]) == {"ab", "ba"}
