import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from patternloom.llm.pii import KINDS, base_spans, find_spans, luhn, train_field

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    """The contract's patterns as they are written."""
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255:
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@+-% ()0123456789é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [(KINDS[k], a, b) for k, a, b in base_spans(text)] == plain(text)


def test_base_spans_in_mixed_text():
    rng = random.Random(4)
    parts = ["a.b@c.de", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111111111111112", "+1 (743) 555-3824", "+12", "a@b.c@d.e", "٣", "0004.1.1.1"]
    for _ in range(300):
        text = rng.choice(["", " ", "\n"]).join(rng.choice(parts) for _ in range(6))
        assert [(KINDS[k], a, b) for k, a, b in base_spans(text)] == plain(text)


def test_padded_numbers_of_any_length():
    for pad in (" " * 200, "." * 3000, " -()." * 100_000):
        for text in (f"call +1{pad}5551234567 now", f"+{pad}5551234567", f"+1{pad}", f"+1{pad}{'5' * 14}", f"+1{pad}{'5' * 15}", f"+1{pad}2 +1{pad}234567890"):
            assert [(KINDS[k], a, b) for k, a, b in base_spans(text)] == plain(text)
    assert base_spans("+1" + " " * 200 + "5551234567") == [(3, 0, 212)]
    assert base_spans("4" * 500_000 + " +" + "1" * 500_000) == []


def test_field_adds_what_is_certain_elsewhere(spark):
    field = train_field(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    card = "4111 1111 1111 1111"
    assert luhn(card.replace(" ", ""))
    text = f"pay with {card} or later 4111111111111111 4111111111111111 end"
    found = find_spans(text, field)
    assert [s[:3] for s in found if s[3]] == [("card", 9, 28)]
    assert [text[a:b] for _, a, b, base in found if not base] == ["4111111111111111"] * 2
    assert find_spans("chapter 12, 3.4 of 1999; 12345678 and 9807915762804491", field) == []
    assert find_spans(None, field) == find_spans("", field) == []
    long = "7 " * 200_000 + "a@b.cd"
    assert ("email", 400_000, 400_006, True) in find_spans(long, None)


def test_field_over_any_text(spark):
    """Digits of any script, in training and prediction."""
    import numpy as np
    from hypothesis import given, settings
    from hypothesis import strategies as st

    from patternloom.llm.pii import FEATURES, Field, base_spans, find_personal_data, find_spans, train_field

    rows = [(k, t) for k, t in enumerate(["².5.6.x@y", "a@b.c 1.2.3.4 ①②③④⑤⑥⑦@x.y", "+1 234 567 8901 ٣٤٥٦٧٨٩ @", "4111 1111 1111 1111"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert find_personal_data(docs, train_field(docs, most=2)).count() == 12
    rng = np.random.default_rng(1)
    pair = rng.normal(0, 1, (3, 5, 5))
    field = Field(rng.normal(0, 1, (FEATURES, 5)), pair + pair.transpose(0, 2, 1))

    @settings(max_examples=300, deadline=None)
    @given(st.text(alphabet=st.one_of(st.sampled_from("0123456789.@+-() a²①٣"), st.characters(exclude_categories=["Cs"])), max_size=60))
    def check(text):
        spans = find_spans(text, field)
        assert [s[:3] for s in spans if s[3]] == [(("email", "ip", "card", "phone")[k], a, b) for k, a, b in base_spans(text)]

    check()


def test_marginals_against_enumeration():
    """Message passing is exact on chains, and near the truth with a skip edge."""
    from itertools import product

    import numpy as np

    from patternloom.llm.pii import FEATURES, Field, marginals

    rng = np.random.default_rng(2)
    for loops in (False, True):
        for n in range(1, 7 if not loops else 5):
            pair = rng.normal(0, 0.4, (3, 5, 5))
            field = Field(rng.normal(0, 1, (FEATURES, 5)), pair + pair.transpose(0, 2, 1))
            x, y = rng.normal(0, 0.5, (n, FEATURES)), np.zeros(n, np.int64)
            if n > 2:
                y[1] = 3
            e = np.array([(i - 1, i, 0) for i in range(1, n)] + [(0, n - 1, 2)] * (loops and n > 2), np.int64).reshape(-1, 3)
            want = np.zeros((n, 5))
            for labels in product(range(5), repeat=n):
                if all(y[i] in (0, l) for i, l in enumerate(labels)):
                    energy = sum(x[i] @ field.node[:, l] for i, l in enumerate(labels)) + sum(field.pair[k, labels[a], labels[b]] for a, b, k in e)
                    want[range(n), labels] += np.exp(energy)
            want /= want.sum(axis=1, keepdims=True)
            got = marginals(field, x, y, e, rounds=200)
            assert np.abs(got - want).max() < (0.1 if loops else 1e-9)
