import random
import re
from collections import defaultdict

from meshflock.llm import near_dup as nd
from meshflock.llm.queries import QUERIES


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    """rows: (doc_id, text) -> {doc_id: component}, by all pairs that share a shingle."""
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    inv = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            inv[g].append(k)
    for k, (d, s) in enumerate(sets):
        hits = defaultdict(int)
        for g in s:
            for o in inv[g]:
                if o > k:
                    hits[o] += 1
        for o, n in hits.items():
            if 100 * n >= percent * (len(s) + len(sets[o][1]) - n):
                a, b = find(d), find(sets[o][0])
                parent[max(a, b)] = min(a, b)
    return {d: find(d) for d in parent}, {k: len(s) for k, (_, s) in enumerate(sets)}


def check(rows, out):
    want, _ = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == want[r.doc_id], (r, want[r.doc_id])
        assert r.kept == (r.doc_id == r.component_id)


def test_chains_and_hot_groups(spark):
    """A chain of small edits, a large group around one text, shared passages, exact copies."""
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    base = rnd.choices(vocab, k=200)
    rows, text = [], base[:]
    for i in range(30):  # neighbours similar, ends far apart
        text = text[:]
        text[rnd.randrange(200)] = f"c{i}"
        text[rnd.randrange(200)] = f"d{i}"
        rows.append(" ".join(text))
    hub = rnd.choices(vocab, k=150)
    for i in range(60):
        t = hub[:]
        t[rnd.randrange(150)] = f"h{i}"
        t[rnd.randrange(150)] = f"g{i}"
        rows.append(" ".join(t).upper() if i % 7 == 0 else "  ".join(t))
    passage = rnd.choices(vocab, k=60)
    rows += [" ".join(rnd.choices(vocab, k=60) + passage) for _ in range(60)]
    rows += [rows[3]] * 5 + ["a b", "A b", "a b c", "", None, None, " ", "x y z u v", "x y z u v x y z u v"]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(rows, nd.group(df).collect())
    # lists in small blocks must say the same
    for block, weight in ((4, 10**9), (10**9, 500)):
        check(rows, nd.group(df, block=block, weight=weight).collect())


def test_far_members_of_a_long_list(spark):
    """A hub whose members are at any distance, some too far from all others."""
    rnd = random.Random(9)
    hub = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(80):
        t = hub[:]
        for j in range(rnd.choice([1, 2, 5, 7, 9])):
            t[rnd.randrange(300)] = f"e{i}x{j}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (3, 10, 1000):
        check(rows, nd.group(df, block=block).collect())


def test_long_texts(spark):
    """Texts far longer than a piece of the hash, one with a changed end."""
    words = [f"w{i % 7919}q{i % 31}" for i in range(300_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-2] + ["x", "y"])), (3, " ".join(words[150_000:])), (4, "a" * 3_000_000)]
    check(rows, nd.group(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1), (1, "a b c d e f", 1), (2, "q r s t u", 1), (None, "q r s t u", 1), (3, None, 1)], "doc_id long, text string, component_id int")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in nd.group(df).collect())
    assert got == [(0, 1, 2, True), (1, 2, 1, True), (1, 2, 1, True), (2, 1, 2, True), (3, 0, 3, True)]
    assert nd.group(df.limit(0)).count() == 0


def test_query(spark):
    d = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    out = QUERIES["op10_near_dup"](spark, d).collect()
    check(rows, out)
    n = {d: len(shingles(t)) for d, t in rows}
    assert all(r.n_shingles == n[r.doc_id] for r in out)
    assert sum(not r.kept for r in out) > 50


def test_postings_are_joined_once(spark, monkeypatch):
    """Lists are joined and written once, and a group twice as large gives twice the rows."""
    written, write = [], nd.materialize

    def counted(df, tag):
        out = write(df, tag)
        written.append((tag, out.count()) if "key" in out.columns else ("", 0))
        return out

    monkeypatch.setattr(nd, "materialize", counted)
    rnd, rows = random.Random(3), []
    for n in (150, 300):
        written.clear()
        hub = [f"w{i}" for i in range(200)]
        texts = [" ".join(f"e{k}" if i == at else w for i, w in enumerate(hub)) for k in range(n) for at in [rnd.randrange(200)]]
        out = nd.group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        assert {r.component_id for r in out} == {0}
        assert [t for t, _ in written if t not in ("", "posted")] == ["blocked"]
        rows.append(sum(k for _, k in written))
    assert 0 < rows[1] < 3 * rows[0], rows
