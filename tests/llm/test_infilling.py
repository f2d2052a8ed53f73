"""Fill-in-middle against a plain version, and its skip list against running sums."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factorloom.llm import infilling

SCHEMA = "doc_id long, text string, n string, form int, output long, _cut string"


def plain_version(doc_id, text, rate=100, spm_rate=50):
    t = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", t)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, t
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_rate:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def awkward():
    rng = random.Random(2)
    texts = [None, "", "\n", "\n\n\n", "one", "one\n", "é\n語\r\n😀 x\n", "a<P>b\n", "<S>", "x\n<M>", "< P>\n<P", "\x00\n\x0b y", "<\n<\nS>\n"]
    texts += ["".join(rng.choice(["word ", "é", "\n", "語\n", "😀", "<", ">", "S>"]) for _ in range(rng.randint(1, 400))) for _ in range(60)]
    texts += ["line 語\n" * 200_000, "no break " * 100_000]
    out = [(i * 7, t, "x", 1, 2, "y") for i, t in enumerate(texts)]
    return out + [out[20], out[20], (None, "a\nb\nc", "x", 1, 2, "y"), (None, None, "x", 1, 2, "y"), (-5, "a\nb\nc\n", "x", 1, 2, "y")]


@pytest.mark.parametrize("rates", [(100, 50), (40, 90), (0, 0)])
def test_forms_and_cuts(spark, rates):
    df = spark.createDataFrame(awkward(), SCHEMA).repartition(3)
    out = infilling.fill_in_middle(df, rate=rates[0], spm_rate=rates[1]).withColumn("restored", infilling.restored(F.col("output"), F.col("form")))
    got = sorted((tuple(r) for r in out.collect()), key=repr)
    want = sorted(((r[0], *plain_version(r[0], r[1], *rates), r[1] or "") for r in awkward()), key=repr)
    assert got == want
    assert infilling.fill_in_middle(df.limit(0)).count() == 0


def test_markers_must_be_told_apart(spark):
    df = spark.createDataFrame([(1, "a\n[b\n")], "doc_id long, text string")
    with pytest.raises(ValueError):
        infilling.fill_in_middle(df, markers=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        infilling.fill_in_middle(df, markers=("<P><", "<S>", "<M>"))
    mine = ("[PRE]", "[SUF]", "[MID]")
    out = infilling.fill_in_middle(df, markers=mine).withColumn("r", infilling.restored(F.col("output"), F.col("form"), mine)).first()
    assert out.r == "a\n[b\n" and out.form != "plain"


def test_lines_of_bytes():
    for t in ["", "a", "\n", "é\n", "語😀\nx", "\n\na\n\n"]:
        lines = re.findall(r"[^\n]*\n|[^\n]+", t)
        assert infilling.line_points(np.frombuffer(t.encode(), np.uint8)).tolist() == [len(x) for x in lines]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=300))
def test_skip_list_finds_every_rank(lengths):
    found = infilling.SkipList(np.array(lengths, np.int64))
    assert [found.find(k) for k in range(len(lengths) + 1)] == np.cumsum([0, *lengths]).tolist()
    for rank in (-1, len(lengths) + 1):
        with pytest.raises(IndexError):
            found.find(rank)


def test_a_descent_takes_few_links():
    n = 200_000
    found = infilling.SkipList(np.ones(n, np.int64))
    assert len(found.lanes) >= 7 and sum(len(u) for u, _, _ in found.lanes) < 1.4 * n

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    found.lanes = [(Counted(u), w, p) for u, w, p in found.lanes]
    ranks = range(0, n + 1, 9973)
    assert [found.find(k) for k in ranks] == list(ranks)
    assert Counted.reads < 60 * len(ranks)
