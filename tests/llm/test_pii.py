import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from seqloom.llm import pii


def brute(text):
    luhn = lambda d: sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda t: re.sub("[^0-9]", "", t)
    rules = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda t: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda t: all(int(p) <= 255 for p in t.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda t: 12 <= len(digits(t)) <= 19 and luhn(digits(t))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: 9 <= len(digits(t)) <= 15),
    ]
    found = [(m.start(), k, m.end(), kind) for k, (kind, p, ok) in enumerate(rules) for m in re.finditer(p, text) if ok(m.group())]
    return [(a, b, kind) for a, _, b, kind in sorted(found)]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@+- %_()5٣é９２0:", max_size=60))
def test_plain_equals_brute_force(text):
    assert pii.find(text)[0] == brute(text)


def test_plain_equals_brute_force_on_digits():
    rng = random.Random(2)
    for _ in range(3000):
        text = "".join(rng.choice(["1", "4", "255", "256", ".", " ", "-", "+", "x", "@", "a.b", "4111111111111111", "(", ")"]) for _ in range(rng.randrange(25)))
        assert pii.find(text)[0] == brute(text), text


DISGUISES = [
    ("mail me: jane.doe [at] example (dot) org now", "email", "jane.doe [at] example (dot) org"),
    ("jane(at)example.com", "email", "jane(at)example.com"),
    ("write jane dot doe at example dot com today", "email", "jane dot doe at example dot com"),
    ("ｊane＠example．com", "email", "ｊane＠example．com"),
    ("jаne@exаmple.com yes", "email", "jаne@exаmple.com"),
    ("call plus one two one two five five five zero one nine nine please", "phone", "plus one two one two five five five zero one nine nine"),
    ("card four one one one one one one one one one one one one one one one.", "card", "four one one one one one one one one one one one one one one one"),
    ("four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one", "card", "four-one-one-one-one-one-one-one-one-one-one-one-one-one-one-one"),
    ("host one nine two dot one six eight dot one dot one up", "ip", "one nine two dot one six eight dot one dot one"),
    ("٤١١١ ١١١١ ١١١١ ١١١١", "card", "٤١١١ ١١١١ ١١١١ ١١١١"),
    ("10․0․0․1", "ip", "10․0․0․1"),
    ("jane​@exam​ple.com", "email", "jane​@exam​ple.com"),
]


def test_disguises_are_found_where_they_stand():
    for text, kind, part in DISGUISES:
        at = text.index(part)
        assert (at, at + len(part), kind) in pii.find(text)[1], (text, pii.find(text))


def test_plain_prose_gains_nothing():
    for text in ["we meet at noon, dot com boom", "one two", "look at example.com", "at dot", "one of two or three", "été à l'école — voilà", "the one at home dot"]:
        assert pii.find(text)[1] == [], text


def test_plain_spans_stay_when_text_is_rewritten():
    text = "a@b.co and c (at) d (dot) org and +1 (212) 555-0199"
    plain, every = pii.find(text)
    assert set(plain) < set(every) and plain == brute(text)


def test_long_texts_are_linear():
    for text in ["a" * 300_000 + "@b", "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "(at)" * 50_000, "one " * 60_000]:
        pii.find(text)


def test_query_rows(spark):
    rows = [(1, None, 0), (2, "", 0), (None, "a@b.co", 0), (3, DISGUISES[0][0], 0), (3, DISGUISES[0][0], 0)]
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string, spans int")).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert sorted((str(r.doc_id), r.n_email, r.base_sha256 == none, r.n_spans) for r in got) == [("1", 0, True, 0), ("2", 0, True, 0), ("3", 0, True, 1), ("3", 0, True, 1), ("None", 1, False, 1)]
    assert pii.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_a_look_alike_in_one_part_keeps_the_whole_address():
    for text in ["jаne@example.com", "to jane@example.cоm.", "jane@exаmple.com jane@x.org"]:
        whole = re.search(r"\S+@\S+?\.c[oо]m", text).span()
        plain, every = pii.find(text)
        assert (*whole, "email") in every and set(plain) <= set(every) and len(every) == len(set(every)), (text, every)
        assert plain == brute(text)


def test_mixed_signs_and_comma_joined_digits_are_found():
    for text in ["john [at] example dot com", "john at example [dot] com", "john@example dot com", "john dot doe (at) mail.example dot org"]:
        assert (0, len(text), "email") in pii.find(text)[1], (text, pii.find(text))
    text = "four" + ",one" * 15
    assert pii.find(text)[1] == [(0, len(text), "card")]
