import re
from collections import Counter

from meshflock.llm import quality as q
from meshflock.llm.queries import QUERIES


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    wins = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(wins)
    covered = {i + k for i, w in enumerate(wins) if often[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


TEXTS = [None, "", " \n\t ", "a", "a a a a", "a b c a b c", "x y\nx y\nx y\n\n \n", "a\r\nb\x0ba\r\nb\x85c\x1cd", "é ü 日本 #*$ <|>", "w " * 3000, " ".join(f"w{i}" for i in range(300)), "a b c d a b c e b c d", "😀 x".encode("utf-16", "surrogatepass").decode("utf-16")]


def test_signals(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(TEXTS + TEXTS)], "doc_id long, text string, n_words int")
    voted = q.with_votes(q.signals(df))
    rows = q.judged(voted, q.Model()).collect()
    assert len(rows) == 2 * len(TEXTS)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(r.text), r.text and r.text[:20]
    empty = q.with_votes(q.signals(df.limit(0)))
    assert q.judged(empty, q.fit(q.patterns(empty))).count() == 0


def test_em_finds_the_bad_rule(spark):
    """Eight rules agree, one votes against them: it is found out."""
    rows = [(*([0] * 6), 1, 1, -1, 80), (*([-1] * 6), -1, -1, 1, 20), (*([0] * 6), 1, 0, -1, 5)]
    df = spark.createDataFrame(rows, ", ".join([*(f"_v_{r} int" for r in q.RULES), "n long"]))
    m = q.fit(df)
    acc = m.accuracies()
    assert 0.7 < m.prior < 0.9 and acc[6][0] > 0.9 and acc[0][1] > 0.9 and acc[8][1] < 0.2
    post = [r.p for r in df.select(m.posterior().alias("p")).collect()]
    assert post[0] > 0.99 and post[1] < 0.01


def test_query(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = QUERIES["op3_quality_rules"](spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id])
    long = [r for r in rows if not r.base_failed and r.doc_id in labels]
    good = [r for r in long if labels[r.doc_id]]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    bad = [r for r in long if not labels[r.doc_id]]
    print(len(good), sum(r.kept for r in good), len(bad), sum(r.kept for r in bad))
    assert sum(r.kept for r in bad) <= 0.5 * len(bad)
    assert not any(r.kept for r in rows if r.base_failed)
