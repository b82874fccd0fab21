"""Quality rules against a plain computation in Python."""

import re
from collections import Counter, defaultdict
from math import log2, sqrt

import pytest

from newsloom.llm import quality as module
from newsloom.llm.quality import COMMON_WORDS, quality

CLASSES = ["[A-Z]", "[0-9]", "[#*$%&|<>]", "[ \t\n\x0b\f\r]", "[.,;:!?'\"()-]"]


def counted(text):
    text = text or ""
    tokens = re.findall("[^ \t\n\x0b\f\r]+", text)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\x0b\f\r")]
    grams = [tuple(tokens[i : i + 3]) for i in range(len(tokens) - 2)]
    often = Counter(grams)
    covered = {i + k for i, gram in enumerate(grams) if often[gram] > 1 for k in range(3)}
    return {
        "tokens": tokens,
        "n_words": len(tokens),
        "word_chars": sum(map(len, tokens)),
        "n_symbols": len(re.findall("[#*$%&|<>]", text)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def distance(p, q):
    total = 0.0
    for x, y in zip(p, q):
        for v in (x, y):
            if v > 0:
                total += v * log2(2 * v / (x + y))
    return sqrt(max(total / 2, 0))


def brute(rows):
    facts, top = {}, defaultdict(Counter)
    for i, text, lang in rows:
        facts[i] = counted(text)
        top[lang].update(facts[i]["tokens"])
    common = {
        lang: [w for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:COMMON_WORDS]] for lang, c in top.items()
    }
    shares, sums = {}, defaultdict(list)
    for i, text, lang in rows:
        text, tokens = text or "", facts[i]["tokens"]
        groups = [len(re.findall(c, text)) for c in CLASSES]
        chars = [n / max(len(text), 1) for n in (*groups, len(text) - sum(groups))]
        known = Counter(common[lang].index(w) + 1 if w in common[lang] else 0 for w in tokens)
        words = [known[k] / max(len(tokens), 1) for k in range(COMMON_WORDS + 1)]
        shares[i] = (chars, words)
        if tokens:
            sums[lang].append(shares[i])
    means = {
        lang: [[sum(x) / len(v) for x in zip(*(s[k] for s in v))] for k in (0, 1)] for lang, v in sums.items()
    }
    out = {}
    for i, _, lang in rows:
        n = facts[i]["n_words"]
        failed = n < 50 or 100 * facts[i]["n_repeat_words"] > 50 * n
        far = [None, None]
        if lang in means:
            far = [distance(shares[i][k], means[lang][k]) for k in (0, 1)]
        near = n > 0 and all(
            d <= limit[0] + limit[1] / sqrt(n)
            for d, limit in zip(far, (module.CHARACTER_LIMIT, module.WORD_LIMIT))
        )
        out[i] = (facts[i], failed, not failed and near, far)
    return out


def check(docs):
    rows = [(r.doc_id, r.text, r.lang) for r in docs.select("doc_id", "text", "lang").collect()]
    want = brute(rows)
    got = quality(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        facts, failed, kept, far = want[r.doc_id]
        for name in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"):
            assert r[name] == facts[name], (r, name)
        assert (r.base_failed, r.kept) == (failed, kept)
        if facts["n_words"]:
            assert [r.character_distance, r.word_distance] == pytest.approx(far)
    return {r.doc_id: r for r in got}


def test_equals_brute_force(documents):
    check(documents)


def test_labelled_documents(spark):
    """Held against the labels: clean documents stay, junk goes."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality(spark.read.parquet(f"{folder}/documents.parquet")).filter("n_words >= 50")
    counts = {(r.quality, r.kept): r["count"] for r in judged.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, False), 0) <= 0.005 * counts[1, True]
    assert counts[0, False] >= 0.8 * (counts[0, False] + counts.get((0, True), 0))


def test_edges(docs_of):
    plain = " ".join(f"word{i} the of and" for i in range(40))
    texts = [None, "", " \n\t", "a", "a b c a b c", plain, plain, "x " * 30_000, "Ärger für die Öffentlichkeit " * 20]
    check(docs_of(texts, lang=[None, "en", "en", "", "en", "en", "en", "de", None], n_words=["x"] * len(texts)))


def test_empty_table(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def test_rare_languages_and_none(docs_of, rng):
    """Clean documents of languages far below a thousandth of the rows, or without one, stay."""
    texts, langs = ["short text"] * 12_000, ["en"] * 12_000
    for lang in ("aa", "bb", "cc", None, None, "dd"):
        own = [f"{lang or len(texts)}{k}" for k in range(30)]
        for _ in range(1 if lang in (None, "dd") else 10):
            texts.append(" ".join(rng.choice(own) for _ in range(150)))
            langs.append(lang)
    junk = len(texts)
    texts.append(" ".join(f"#{k}$" for k in range(150)))
    langs.append("en")
    got = {r.doc_id: r.kept for r in quality(docs_of(texts, lang=langs)).filter("n_words >= 50").collect()}
    assert len(got) == junk + 1 - 12_000 and not got.pop(junk)
    assert all(got.values())


def test_common_words_are_exact(docs_of):
    """Far more distinct words than a sketch of 10,000 counters holds, and close counts near the last place."""
    rare = [f"r{k}" for k in range(60_000)]
    often = [f"w{k:02}" for k in range(64) for _ in range(3 + (k < 32))]
    words = [w for k in range(0, len(rare), 600) for w in rare[k : k + 600] + often[k // 600 :: 100]] + rare
    docs = docs_of([" ".join(words[k : k + 500]) for k in range(0, len(words), 500)], language=["x"] * (-(-len(words) // 500)))
    (got,) = module._common_words(docs.selectExpr("language", "split(text, ' ') as words"), 32).collect()
    assert list(got.common) == [f"w{k:02}" for k in range(32)]
