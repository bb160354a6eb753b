import re

from llm.helpers import documents, edge_rows, ordered, random_texts
from pagetide.llm import quality, weak

FIELDS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def brute(doc_id, text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {j for v in at.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (
        doc_id, n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(repeated),
        n < 50 or 100 * len(repeated) > 50 * n,
    )


def test_base_features_match_brute_force(spark):
    rows = edge_rows() + [(100 + i, t, "a") for i, t in enumerate(random_texts(1))] + [(500, "a | b # c\n" * 40, "a")]
    out = quality.assess(documents(spark, rows, extra=True), ["doc_id"])
    got = out.select(*FIELDS).collect()
    assert ordered(got) == ordered(brute(d, t) for d, t, _ in rows)
    assert out.filter("base_failed and kept").isEmpty()


def test_symbols_and_repeats_are_rejected_and_prose_stays(spark):
    import random

    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeioutnrs") for _ in range(rnd.randint(2, 8)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(8))
    rows = [(i, prose(), "a") for i in range(90)]
    rows += [(1000 + i, prose().replace(" ", "### ").replace(".", "$$$."), "a") for i in range(8)]
    rows += [(2000 + i, " ".join([word()] * 60 + [word()] * 60), "a") for i in range(8)]
    kept = {r.doc_id for r in quality.keep_good(documents(spark, rows)).collect()}
    assert kept == set(range(90))


def test_keep_good_keeps_columns_and_empty_table(spark):
    df = documents(spark, edge_rows(), extra=True)
    assert quality.keep_good(df).columns == df.columns
    assert quality.assess(df.limit(0), ["doc_id"]).count() == 0


def test_em_recovers_a_reliable_labeler(spark):
    import random

    rnd = random.Random(3)
    rows = []
    for _ in range(3000):
        y = 1 if rnd.random() < 0.6 else -1
        vote = lambda acc: y if rnd.random() < acc else -y  # noqa: B023,E731
        rows.append((vote(0.95), vote(0.8), vote(0.6)))
    m = weak.fit(spark.createDataFrame(rows, "a int, b int, c int"), ["a", "b", "c"])
    assert m.reliabilities[0] > m.reliabilities[1] > m.reliabilities[2]
    assert abs(m.reliabilities[0] - 0.95) < 0.1
