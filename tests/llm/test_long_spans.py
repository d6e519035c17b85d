"""Candidates of personal data that are longer than usual."""

import time

from tabloom.llm import pii

JWT = "eyJ" + "aB3x9Q" * 60


def found(text):
    return [(k, text[s:e], pii.votes(text, k, s, e, base)) for k, s, e, base in pii.candidates(text)]


def test_long_secret_is_one_span():
    (kind, span, votes), = found(f"login with token={JWT} today")
    assert (kind, span) == ("secret", JWT)
    assert votes[pii.LABELERS.index("inside_token")] == 0


def test_long_spelled_address_is_one_span():
    for spelled in ("a.b" * 40 + " [at] example [dot] com", "me(at)" + "host" * 20 + ".com", "info [at] x [dot] " + "verylong" * 5 + " [dot] de"):
        (kind, span, votes), = found(f"write to {spelled} today")
        assert (kind, span) == ("email", spelled)
        assert votes[pii.LABELERS.index("inside_token")] == 0


def test_short_spans_as_before():
    assert [x[:2] for x in found("a[at]b.com_x [at] c.de, token:'abc' secret = hunter2hunter2; token=token=token=abc")] == [("email", "a[at]b.com"), ("email", "_x [at] c.de"), ("secret", "hunter2hunter2"), ("secret", "token=token=abc")]


def test_long_runs_take_linear_time():
    at = time.time()
    for text in ("token=" * 100_000, "a" * 500_000 + "(at", "a(at)" * 100_000):
        list(pii.candidates(text))
    assert time.time() - at < 10
