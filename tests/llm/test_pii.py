import re

from hypothesis import given, settings, strategies as st

from mailtriage.llm import skip_chain_pii as P
from tests.llm.conftest import ODD


def brute(text):
    out = []
    for kind, pattern in P.PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(digits[::-1])) % 10 == 0
            ok = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}
            if ok[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], P.KINDS.index(s[0])))


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a.@0125+-() \n%é²٣", max_size=60))
def test_base_spans_are_those_of_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_known_cases():
    text = "1.2.3.4.5.6.7.8 a@b a@b.c@d.e x@@y.z 0001.2.3.255 1.2.3.256 4111 1111-1111 1111, 4111111111111112 +1 (017) 555-7713 +12"
    assert P.base_spans(text) == brute(text) and len(P.base_spans(text)) == 5


def test_digits_of_other_scripts_are_no_octets(spark):
    docs = spark.createDataFrame([(i, f"host 10.{i % 256}.{i % 7}.{i % 199} is up") for i in range(600)], "doc_id bigint, text string")
    model = P.fit(docs)
    texts = [f"host 192.168.100.{d} is up" for d in ("²", "٣", "1²", "①", "3")]
    for text, (base, spans) in zip(texts, model.spans(texts)):
        assert base == brute(text) and all(P._plausible(k, text[s:e]) for k, s, e in spans)
    assert [P._plausible("ip", f"1.2.3.{d}") for d in ("²", "٣", "", "3")] == [False, False, False, True]


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "@" * 100_000):
        P.base_spans(text)
        P.nodes_of(text, [])


def corpus():
    rows = []
    for i in range(400):
        phone, card = f"+1 ({100 + i % 800:03d}) 555-{1000 + i}", "4111 1111 1111 1111".replace(" ", "")
        rows.append((i, f"some words {i % 10} before {phone} then u{i}@mail{i % 7}.example.com and {card} or 10.0.{i % 256}.{i % 7} at 3.5 end {i}"))
    return rows


def test_the_field_adds_what_the_patterns_lose(spark):
    docs = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    model = P.fit(docs)
    text = "call +1 (826) 555-4081 190.137.223.204 du jour 12 or 3.5"
    base, spans = model.spans([text])[0]
    assert [text[a:b] for k, a, b in spans if k == "phone"] == ["+1 (826) 555-4081"] and ("ip", 23, 38) in base
    clean = "in 1999 some 12345678 words 3.5 and 2390409500648961 x2y"
    assert model.spans([clean])[0] == ([], [])
    assert all(set(b) <= set(s) for b, s in model.spans([t for _, t in corpus()]))


def test_repeated_tokens_agree():
    import numpy as np

    weights = np.zeros((P.TABLE_SIZE, 5))
    weights[:, 0] = 0.01
    model = P.SkipChainModel(weights, np.zeros((5, 5)), 4.0)
    text = "+1 415 555 7713 and later 14155557713 more 5551234 words"
    nodes = P.nodes_of(text, [("phone", 0, 15)])
    nodes.skip.append((0, 4))
    probs = model.marginals([nodes])[0]
    assert probs[4].argmax() == 4 and probs[5].argmax() == 0


def test_odd_rows(odd, none):
    model = P.fit(odd)
    got = P.with_spans(odd.drop("spans"), model).collect()
    assert len(got) == len(ODD)
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert all(r.n_email == 0 and r.base_sha256 == empty for r in got if not r.text)
    assert P.with_spans(none, P.fit(none)).count() == 0
