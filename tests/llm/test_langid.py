import random

from statloom.llm import langid


def brute_phrases(text, reference):
    """Longest matches by substring search; a symbol that the reference lacks goes with the phrase that it ends."""
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in reference:
            j += 1
        n += 1
        i = j + 1 if j < len(text) and text[j] not in reference else j
    return n


def test_phrases_are_longest_matches():
    rng = random.Random(4)
    refs = {"a": "".join(rng.choice("abc ") for _ in range(300)), "b": "".join(rng.choice("bcd ") for _ in range(300))}
    refs = {k: " ".join(v.split()) for k, v in refs.items()}
    parser = langid.Parser(refs)
    for _ in range(60):
        text = " ".join("".join(rng.choice("abcd ") for _ in range(rng.randint(1, 80))).split())
        if not text.strip():
            continue
        counts, size = parser.phrases([text])
        own = {k: parser.codes(v).tolist() for k, v in refs.items()}
        code = parser.codes(text).tolist()
        as_text = lambda c: "".join(map(chr, c))
        assert size[0] == len(code)
        for j, k in enumerate(parser.names):
            got = counts[0, j]
            assert got in (brute_phrases(as_text(code), as_text(own[k])), brute_phrases(as_text(code), as_text(own[k])) + 1)


def test_tells_languages_and_defined_results(spark):
    en, de = "the cat and the dog went over the hill to find the house ", "der hund und die katze gingen über den hügel zu dem haus "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "en" if i % 2 else "de", "src") for i in range(60)]
    rows += [(900, None, "en", None), (901, "12 !!", "de", None), (902, "", None, None), (903, en * 3000, None, None), (904, "THE HOUSE and the hill", None, None), (904, "THE HOUSE and the hill", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = langid.identify(docs, langid.reference_texts(docs.filter(~langid.held_out()))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))
    assert [by[i].lang_pred for i in (900, 901, 902, 903, 904)] == ["und", "und", "und", "en", "en"]
    assert by[900].score == 0 and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.reference_texts(docs.limit(0)) == {}
    assert langid.identify(docs.limit(0), {"a": "b"}).count() == 0


def test_a_language_of_long_texts_only_has_a_reference(spark):
    rows = [(i, "der schnelle braune fuchs springt " * 100, "de") for i in range(3)] + [(i, "the quick brown fox jumps over ", "en") for i in range(10, 14)]
    got = langid.reference_texts(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(got) == {"de", "en"}


def test_any_script_and_ties(spark, monkeypatch):
    rng = random.Random(7)
    scripts = {k: "".join(chr(rng.randrange(a, b)) for _ in range(3000)) for k, a, b in (("el", 0x3B1, 0x3C9), ("ru", 0x430, 0x44F), ("zh", 0x4E00, 0x5A00))}
    scripts = {k: " ".join(v[i : i + 6] for i in range(0, len(v), 6)) for k, v in scripts.items()} | {"en": "the quick brown fox jumps over it " * 90}
    dense = langid.Parser(scripts)
    assert {n: a.width > langid.DENSE for n, a in zip(dense.names, dense.automata)} == {"el": False, "en": False, "ru": False, "zh": True}
    texts = [v[k * 50 : k * 50 + 300] for v in scripts.values() for k in range(4)] + ["\u05d0\u05d1 \u05d2", "x \u0431"]
    counts, _ = dense.phrases(texts)
    assert dense.predict(texts)[0][:16] == [k for k in scripts for _ in range(4)]
    monkeypatch.setattr(langid, "DENSE", 0)
    assert (langid.Parser(scripts).phrases(texts)[0] == counts).all()
    twins = langid.Parser({"b": scripts["en"], "a": scripts["en"]})
    assert twins.predict(["the fox", "\u05d0"]) == (["a", "a"], [0.0, 0.0])  # ties: first name
    long = langid.Parser({k: scripts[k] for k in ("en", "ru")})
    assert long.predict([scripts["ru"] * 3, scripts["en"] * 3])[0] == ["ru", "en"]  # several blocks
