"""Patterns that only run where their letters are."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from casequarry.functions import text as tx
from casequarry.operators import guards
from casequarry.sources.config import default_config


@pytest.mark.parametrize(("pattern", "want"), [
    (r"[a-z]+@[a-z]+\.com", (["\\.com".replace("\\", "")], False)), (r"DE[0-9]{2}[A-Z]{18}", (["DE"], False)), (r"[0-9]+/[0-9]+", (["/"], False)),
    (r"(?i)ignore (all )?previous", (["previous"], True)), (r"(foo|barbaz)+x", (["barbaz", "foo"], False)), (r"(foo|b*)x", (["x"], False)),
    (r"[0-9]{4}", ([], False)), (r"(?i)straße", ([], False)), (r"a?b*c", (["c"], False)), (r"(?:ab){2,}", (["ab"], False)), (r"x(?i:Y)z", (["x"], False)),
    (r"\bIBAN\b|\bBIC\b", (["BIC", "IBAN"], False)), (r"(?<=abc)\d", ([], False)), (r"(", ([], False)),
])
def test_required_literals(pattern, want):
    got = tx.required_literals(pattern)
    assert got == want or (pattern.startswith("x(?i") and got[0] in (["x"], ["z"]))


ATOMS = st.sampled_from(["a", "b", "ab", "[ab]", "a?", "b+", "(ab|b)", "(a|)", "(?:ba)*", ".", r"\d", "1", "(?:1a){1,2}"])


@settings(max_examples=300, deadline=None)
@given(st.lists(ATOMS, min_size=1, max_size=5).map("".join), st.booleans(), st.text("abAB1", max_size=12))
def test_no_match_lacks_its_literals(pattern, fold, text):
    pattern = ("(?i)" if fold else "") + pattern
    literals, lower = tx.required_literals(pattern)
    if literals and re.search(pattern, text):
        assert any(x in (text.lower() if lower else text) for x in literals)


def reference(text, code, patterns):
    n, flags = 0, []
    for p in patterns:
        if p["scope"] in ("global", code) and text is not None:
            text, k = re.subn(p["pattern"], p["replacement"], text)
            n += k
            if k:
                flags.append(f"PII_{p['name'].upper()}_DETECTED")
    return text, n, flags


def many(count):
    rng = random.Random(1)
    shapes = [r"K{n}-[0-9]{{3}}", r"(?i)key{n}:\w+", r"[0-9]{{4}}x{n}\b", r"(alpha|beta){n}=([a-z]+)", r"[a-f]{n}q"]
    return [
        dict(scope=rng.choice(["global", "DE", "AT"]), pos=k, name=f"p{k}", pattern=shapes[k % 5].format(n=k % 37 + 1), replacement=rng.choice(["[X]", "[$Y\\\\]", f"[{k}]"]), sensitivity="low")
        for k in range(count)
    ]


@pytest.mark.parametrize("count", [4, 200])
def test_many_patterns_equal_one_after_the_other(spark, count):
    rng = random.Random(2)
    bits = ["K3-123", "KEY7:abc", "4711x9 ", "alpha4=foo", "beta12=zz", "abcde", "fq", "K12-999K1-000", "plain", "\n", "ä€", "[5]", "$Y"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(12))), rng.choice(["DE", "AT", None])) for k in range(300)] + [(300, None, "DE")]
    df = spark.createDataFrame(rows, "id long, text string, country_code string")
    patterns = many(count)
    got = {r.id: (r.pii_text, r.pii_count, r.pii_flags) for r in guards.redact(df, "text", patterns).collect()}
    assert got == {k: reference(t, c, patterns) for k, t, c in rows}


def test_both_forms_agree_on_the_given_patterns(spark, monkeypatch):
    patterns = default_config().pii_patterns()
    texts = ["mail a.b@c.de now", "DE12ABCDEFGH0123456789", "+49 30 1234567", "12/345/67890", "nothing", None, "", "a@b.cc +49 30 1234567 DE12ABCDEFGH0123456789"]
    df = spark.createDataFrame([(k, t, c) for k, t in enumerate(texts) for c in ("DE", "AT")], "id long, text string, country_code string")
    plain = sorted(map(str, guards.redact(df, "text", patterns).collect()))
    monkeypatch.setattr(guards, "UNROLLED", 0)
    assert sorted(map(str, guards.redact(df, "text", patterns).collect())) == plain


def test_first_match_with_literals(spark):
    patterns = [r"(?i)ignore\s+previous", r"jail(break|er)", r"\d{5}"]
    df = spark.createDataFrame([("please IGNORE  previous",), ("a jailer",), ("12345 jailbreak",), ("123456",), ("ignore next",), (None,)], "t string")
    got = [r.hit for r in df.select(tx.first_match(F.col("t"), patterns).alias("hit")).collect()]
    assert got == [patterns[0], patterns[1], patterns[1], patterns[2], None, None]
