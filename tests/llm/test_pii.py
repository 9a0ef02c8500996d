import random
import re
from hashlib import sha256

import pyarrow as pa
import pytest

from statloom.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    """Base spans by the patterns as they stand."""
    def luhn(s):
        d = [int(c) for c in s][::-1]
        return sum(d[0::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0

    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def spans_of(text):
    return next(pii.find_spans(pa.array([text], pa.string())))


def base(text):
    return [(k, a, b) for k, a, b, plain, _ in spans_of(text) if plain]


def added(text):
    return [(k, text[a:b], form) for k, a, b, plain, form in spans_of(text) if not plain]


def test_base_spans_match_the_patterns():
    rng = random.Random(4)
    for _ in range(6000):
        text = "".join(rng.choice(["1", "2", "25", "0", "9", ".", ".", "-", " ", "@", "@", "a", "b.c", "+", "(", ")", "é", "%", "\n", "4111 1111 1111 1111", "1.2.3.4"]) for _ in range(rng.randint(0, 40)))
        assert base(text) == brute(text), text


@pytest.mark.parametrize(
    ("text", "kind", "source", "form"),
    [
        ("mail jane.roe [at] mail7 [dot] example [dot] com now", "email", "jane.roe [at] mail7 [dot] example [dot] com", "jane.roe@mail7.example.com"),
        ("mail jane(at)example(dot)org.", "email", "jane(at)example(dot)org", "jane@example.org"),
        ("write to jane at example dot com today", "email", "jane at example dot com", "jane@example.com"),
        ("write to j dot roe AT example DOT com", "email", "j dot roe AT example DOT com", "j.roe@example.com"),
        ("jane_at_example_dot_com", "email", "jane_at_example_dot_com", "jane@example.com"),
        ("roe34 at example.com", "email", "roe34 at example.com", "roe34@example.com"),
        ("jаne@exаmple.com", "email", "jаne@exаmple.com", "jane@example.com"),  # Cyrillic a
        ("jane＠example．com", "email", "jane＠example．com", "jane@example.com"),
        ("ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com", "jane@example.com"),
        ("jane @ example [.] com", "email", "jane @ example [.] com", "jane@example.com"),
        ("juana arroba ejemplo punto es", "email", "juana arroba ejemplo punto es", "juana@ejemplo.es"),
        ("host 97[.]51[.]17[.]173 is", "ip", "97[.]51[.]17[.]173", "97.51.17.173"),
        ("host 97 dot 51 dot 17 dot 173 is", "ip", "97 dot 51 dot 17 dot 173", "97.51.17.173"),
        ("one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one", "192.168.0.1"),
        ("９７.５１.１７.１７３", "ip", "９７.５１.１７.１７３", "97.51.17.173"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
        ("card 4111 1111 llll 1111", "card", None, None),
        ("card 4l11 111l 1I11 1111 ok", "card", "4l11 111l 1I11 1111", "4111 1111 1111 1111"),
        ("card ٤١١١١١١١١١١١١١١١", "card", "٤١١١١١١١١١١١١١١١", "4111111111111111"),
        ("call plus one five five five double one two three four five six", "phone", "plus one five five five double one two three four five six", "+15551123456"),
        ("call ＋1 (017) 555–7713 now", "phone", "＋1 (017) 555–7713", "+1 (017) 555-7713"),
        ("call +1 (O17) 555-77l3 now", "phone", "+1 (O17) 555-77l3", "+1 (017) 555-7713"),
        ("+eins zwei drei vier fünf sechs sieben acht neun null", "phone", "+eins zwei drei vier fünf sechs sieben acht neun null", "+1234567890"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, source, form):
    got = added(text)
    assert got == ([(kind, source, form)] if source else [])


def test_clean_prose_gets_no_spans():
    for text in (
        "Look at this. At one point, two of them met at noon; dot the i.", "Meet us at www.example.com or at home.", "He was one of five, and I was at zero.", "au point de vue, un deux trois", "• first · second",
        "plus one more thing at 5 o clock", "version 1.2.3 of ten", "Привет, мир. Это текст.", "ééé àà ßß", "one. two. three. four.", "a@b", "@", "", "+", "+1 2",
    ):
        assert spans_of(text) == [], text


def test_base_spans_stay_beside_added_ones():
    text = "a.b@mail.com, jane [at] example [dot] com and ａ１@x.org"
    spans = spans_of(text)
    assert base(text) == brute(text) and [text[a:b] for k, a, b, plain, _ in spans if not plain] == ["jane [at] example [dot] com", "ａ１@x.org"]


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+" * 400_000, "one " * 100_000, " at " * 100_000, "о" * 200_000, "l" * 300_000 + "1", "(" * 300_000, "+1" + " " * 300_000):
        spans_of(text)


def test_query_rows_and_odd_tables(spark):
    texts = [None, "", "x 1.2.3.4 a@b.cc", "é​ jane [at] b [dot] cc +1 (017) 555-7713"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, "1.2.3.4")], "doc_id long, text string").selectExpr("*", "'x' AS spans", "1 AS kind")
    got = pii.digests(pii.personal_data(docs)).collect()
    assert len(got) == 6
    by = {r.doc_id: r for r in got}
    for i, t in enumerate(texts):
        want = brute(t or "")
        r = by[i]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in want) for k in pii.KINDS]
        assert r.base_sha256 == sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
    assert by[3].spans == "email:3:23,phone:24:41" and by[3].n_added == 1 and by[None].n_ip == 1 and by[0].spans == ""
    assert pii.digests(pii.personal_data(docs.limit(0))).count() == 0
