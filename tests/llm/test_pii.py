import hashlib
import re

import pytest

from meshflock.llm import pii
from meshflock.llm.queries import QUERIES

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, (kind, rx) in enumerate(BASE.items()):
        for m in re.finditer(rx, text):
            d = re.sub("[^0-9]", "", m[0])
            s = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1]))
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 12 <= len(d) <= 19 and s % 10 == 0 or kind == "phone" and 9 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


TEXTS = ["", "a@b", "a@b.c@d.e f@g.h.", "x@@y.z", "..@-.-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1", "4111 1111-1111 1111 9", "4111111111111111", "411111111111 1111 x",
         "+1 (487) 555-7209) +12345678 +1234567890123456 +1..2", "é a.b+c@x-y.co 10.0.0.255", "1 2 3 4", "+", "9" * 400, "1." * 300, "@" * 50 + "a@" * 50, "+1" + " (" * 99]


@pytest.mark.parametrize("text", TEXTS)
def test_base_equals_patterns(text):
    assert pii.base_spans(text) == brute(text)


HIDDEN = [
    ("write to john.smith [at] example [dot] com now", "john.smith [at] example [dot] com", "email"),
    ("write to john at example dot com now", "john at example dot com", "email"),
    ("mail jane(at)example.org please", "jane(at)example.org", "email"),
    ("mail jаne@exаmple.com ok", "jаne@exаmple.com", "email"),  # Cyrillic а
    ("call plus one four eight seven five five five seven two zero nine today", "plus one four eight seven five five five seven two zero nine", "phone"),
    ("number four one one one one one one one one one one one one one one one ok", "four one one one one one one one one one one one one one one one", "card"),
    ("host １９２．１６８．０．１ up", "１９２．１６８．０．１", "ip"),
    ("card 4111\u200b111111111111 x", "4111\u200b111111111111", "card"),
    ("dial four eight seven five five five seven two zero nine", "four eight seven five five five seven two zero nine", "phone"),
]


@pytest.mark.parametrize("text,hidden,kind", HIDDEN)
def test_disguises_map_back(text, hidden, kind):
    base = pii.base_spans(text)
    got = [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(text, base)]
    assert (kind, hidden) in got, (base, got)


@pytest.mark.parametrize("text", ["look at the house dot by dot", "we met at noon. one two three", "at dot at dot", "seven samurai at example.com", "two–three of 4", "привет как дела", "one, two, three, four, five"])
def test_prose_is_left_alone(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_long_digit_words_are_quick():
    text = "one two " * 20000 + "dot at " * 20000
    assert len(pii.added_spans(text, [])) < 3


def test_table(spark):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate([*TEXTS, *(h[0] for h in HIDDEN), None])], "doc_id long, text string, spans long")
    out = pii.find(df).collect()
    assert len(out) == df.count()
    for r in out:
        want = pii.joined(brute(r.text or ""))
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
        assert (r.masked is None) == (r.text is None)
    assert pii.find(df.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    rows = QUERIES["op9_pii"](spark, d).collect()
    assert len(rows) == len(texts) and sum(r.n_email for r in rows) > 5
    for r in rows:
        want = brute(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert r.base_sha256 == hashlib.sha256(pii.joined(want).encode()).hexdigest()


GROUPS = [
    ("call plus one 415 five five five 0199 now", "plus one 415 five five five 0199"),
    ("call +1 415 five five five 0199 now", "+1 415 five five five 0199"),
    ("call 415 five five five 0199 now", "415 five five five 0199"),
    ("call +1 four one five 555-0199 now", "+1 four one five 555-0199"),
    ("call +1 415 five 55 0199 now", "+1 415 five 55 0199"),
]


@pytest.mark.parametrize("text,hidden", GROUPS)
def test_words_next_to_groups_of_digits(text, hidden):
    assert [(pii.KINDS[k], text[a:b]) for a, k, b in pii.added_spans(text, pii.base_spans(text))] == [("phone", hidden)]


@pytest.mark.parametrize("text", ["in 2019, five of 300 came", "two 2019-05-12 and 7", "two 2019-05-12 12", "one, two, three, 2019, 2020", "chapters one, two, three, 12", "room 415 five", "one of 1,000,000"])
def test_figures_in_prose_are_left_alone(text):
    assert pii.added_spans(text, pii.base_spans(text)) == []


def test_a_group_beside_a_spelled_number_loses_nothing():
    text = "in 2019 2020 dial four eight seven five five five seven two zero nine"
    assert [text[a:b] for a, _, b in pii.added_spans(text, pii.base_spans(text))] == ["four eight seven five five five seven two zero nine"]
