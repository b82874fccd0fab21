"""Extracts against plain Python, with and without common words; the hook."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from newsloom.functions.text import WHITE_SPACE
from newsloom.operators import summary
from newsloom.operators.summary import extractive_summary, map_texts


def brute_force(texts, min_words, max_words):
    texts = {i: " ".join((text or "").split()) for i, text in texts.items()}
    usage = Counter(word for text in texts.values() for word in set(text.lower().split(" ")))
    extracts = {}
    for i, text in texts.items():
        sentences = re.sub(r"([.!?]) ", "\\1\n", text).split("\n")
        words = [sentence.split(" ") for sentence in sentences]
        scores = [sum(1_000_000 // usage[w.lower()] for w in ws) // len(ws) for ws in words]
        if sum(map(len, words)) < min_words:
            kept = range(len(words))
        else:
            kept, used = [], 0
            for rank, pos in enumerate(sorted(range(len(words)), key=lambda p: (-scores[p], p))):
                used += min(len(words[pos]), max_words)
                if rank == 0 or used <= max_words:
                    kept.append(pos)
        extracts[i] = " ".join(" ".join(words[pos][:max_words]) for pos in sorted(kept))
    return extracts


@pytest.mark.parametrize("most", [1, 30, 1_000_000])
def test_equals_brute_force(spark, monkeypatch, most):
    """``most`` moves words between the broadcast and the shuffled lookup."""
    monkeypatch.setattr(summary, "MAX_COMMON_WORDS", most)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["The"] * 20
    texts = {
        i: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ".", "!\n"]) for _ in range(rng.randrange(0, 60)))
        for i in range(60)
    }
    texts[60], texts[61] = None, "run " * 50
    docs = spark.createDataFrame(list(texts.items()), "id long, content string")
    got = {r.id: r.summary for r in summary.extractive_summary(docs, min_words=10, max_words=20).collect()}
    assert got == brute_force(texts, 10, 20)


def test_words_are_exploded_and_split_once(spark):
    """One pass over the words of the sentences, and no filter that splits each sentence another time."""
    docs = spark.createDataFrame([(1, "One two. Three four.")], "id long, content string")
    plan = extractive_summary(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1  # it was 2
    assert "size(split(" not in plan.replace("AS n_words", "")


def test_seldom_words_are_common_while_there_is_room(spark, monkeypatch):
    """Words below the share are looked up by broadcast too, as long as no more than MAX_COMMON_WORDS are; the rest is not lost."""
    monkeypatch.setattr(summary, "MAX_COMMON_WORDS", 30)
    texts = {i: f"the a{i % 20} b{i} here. the c{i} c{i} too!" for i in range(100)}
    docs = spark.createDataFrame(list(texts.items()), "id long, content string")
    found = summary.extractive_summary(docs, min_words=1, max_words=4)
    assert {r.id: r.summary for r in found.collect()} == brute_force(texts, 1, 4)
    # 20 words in 5 documents and 2 in 100: by the share, 500 of 30, only 2 were common.
    uses = [("a", 100), ("b", 100)] + [(f"c{i}", 5) for i in range(20)] + [(f"d{i}", 1) for i in range(200)]
    assert spark.createDataFrame(uses, "word string, n_docs long").agg(summary._least_use()).first()[0] == 2


def test_single_blanks_are_left_alone(spark):
    """The pattern changes texts as the whole of WHITE_SPACE does, but finds nothing in an even text."""
    rng = random.Random(5)
    signs = "  ab." + "\t\n\x0b\x1c\x1f\x85\xa0\u2003\u200b" + "é\U0001f600"
    texts = [("".join(rng.choice(signs) for _ in range(rng.randrange(12))),) for _ in range(5000)]
    changed = [F.regexp_replace("t", pattern, " ") for pattern in (WHITE_SPACE, summary.UNEVEN_SPACE)]
    rows = spark.createDataFrame([*texts, ("a b. c",)], "t string").select("t", *[c.alias(f"c{i}") for i, c in enumerate(changed)])
    assert rows.filter("c0 <> c1").count() == 0
    assert rows.filter(F.expr("t = 'a b. c'") & F.col("t").rlike(summary.UNEVEN_SPACE)).count() == 0


def test_hook_failures_and_blanks(spark):
    def load():
        def model(texts):
            if any("bad" in text for text in texts):
                raise ValueError("no")
            return [text.upper() for text in texts]

        return model

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, " "), (4, None)], "id int, t string").coalesce(1)
    got = {r.id: r.out for r in summary.map_texts(rows, load, "t", "out").collect()}
    assert got == {1: "A", 2: "", 3: "", 4: ""}


def test_summary_text_falls_back(spark):
    rows = spark.createDataFrame([("c", "s"), (" ", "s"), (None, None)], "content string, summary string")
    assert [r[0] for r in rows.select(summary.summary_text(rows)).collect()] == ["c", "s", ""]


def test_long_words_are_broadcast_as_hashes(spark):
    """Texts that share data URIs of 100 kB: what is broadcast has a few bytes a word, and the result is the same."""
    uris = [f"data:{i}," + "A" * 100_000 for i in range(3)]
    docs = spark.createDataFrame(
        [(i, f"Short words here. {uris[i % 3]} and {uris[(i + 1) % 3]} too. " + "Filler text follows. " * 12) for i in range(9)],
        "id long, content string",
    )
    summary = extractive_summary(docs)
    rows = summary.collect()
    assert len(rows) == 9 and all(r.summary for r in rows)
    plan = summary._jdf.queryExecution().executedPlan().toString()
    sizes = [m for m in plan.split("\n") if "BroadcastExchange" in m]
    assert sizes and all("string" not in line for line in sizes)


@pytest.mark.parametrize(
    "model, expected",
    [
        (lambda texts: texts[:-1] if len(texts) > 1 else [texts[0].upper()], ["A", "B", "", "C"]),
        (lambda texts: [texts[0]] * 2, ["", "", "", ""]),
        (lambda texts: [], ["", "", "", ""]),
        (lambda texts: [None for _ in texts], ["", "", "", ""]),
        (lambda texts: [t.upper() if t != "b" else 1 / 0 for t in texts], ["A", "", "", "C"]),
    ],
)
def test_models_that_answer_wrongly(spark, model, expected):
    """Too few or too many answers, none, no texts, or an error: the task goes on, and failures are told from blanks."""
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, " "), (3, "c")], "id long, text string").coalesce(1)
    got = map_texts(rows, lambda: model, "text", "answer", "failed").orderBy("id").collect()
    assert [r.answer for r in got] == expected
    assert [r.failed for r in got] == [answer == "" and i != 2 for i, answer in enumerate(expected)]


def test_one_long_answer_does_not_widen_the_others(spark):
    """A batch of short texts and a long one takes the memory of its texts, not of rows times the longest."""

    def load():
        import resource

        peaks = []

        def model(texts):
            peaks.append(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)
            return [str(peaks[-1] - peaks[0]), *texts[1:]]

        return model

    rows = spark.range(0, 20_000, 1, 1).selectExpr("id", "repeat('x', if(id = 5, 40000, 3)) as text")
    got = {r.id: r.answer for r in map_texts(rows, load, "text", "answer").collect()}
    assert len(got) == 20_000 and len(got[5]) == 40_000 and got[7] == "xxx"
    assert max(int(answer) for answer in got.values() if answer.isdigit()) < 400  # MB; it was 1600
