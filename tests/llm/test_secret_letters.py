"""Random runs of letters alone are secrets; identifiers of words are not."""

from __future__ import annotations

import random
import string

import public_tokenizers
import pytest
from helpers import documents

from siltstone.llm import secret_scan

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters])
@pytest.mark.parametrize("size", [20, 32, 48])
def test_random_letters_are_found(letters, size):
    rng, scanner = random.Random(size), secret_scan.Scanner(RANKS)
    runs = ["".join(rng.choice(letters) for _ in range(size)) for _ in range(200)]
    found = [scanner.random(f"key {x} end") == [(4, 3, 4 + size)] for x in runs]
    assert sum(found) >= 0.97 * len(runs)


@pytest.mark.parametrize("signs", [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", string.ascii_uppercase + "234567"])
@pytest.mark.parametrize("size", [20, 32, 44, 64])
def test_recall_of_random_strings(signs, size):
    """At least 97 of 100 random strings have a span that covers all but signs at their ends."""
    rng, scanner = random.Random(size), secret_scan.Scanner(RANKS)
    runs = ["".join(rng.choice(signs) for _ in range(size)) for _ in range(300)]
    found = sum(any(s <= 4 and e >= 4 + size for s, _, e in scanner.random(f"key {x} end")) for x in runs)
    assert found >= 0.97 * len(runs), found


def test_a_number_after_random_letters_hides_nothing():
    assert secret_scan.Scanner(RANKS).random("qwkzjxvbpmtrhgfdslwqxzkp-7")


@pytest.mark.parametrize("run", ["MAXIMUM_CONNECTION_RETRY_COUNT", "DEFAULT_HTTP_REQUEST_TIMEOUT", "XMLHttpRequestEventTarget", "getElementsByTagNameNS", "usr/local/share/applications", "to-be-or-not-to-be-that-is", "release-candidate-notes-7", "=-=-=-=-=-=-=-=-=-=-=-=-"])
def test_identifiers_of_words_are_not(run):
    assert not secret_scan.Scanner(RANKS).random(f"see {run} there")


def test_random_letters_are_redacted(spark):
    run = "qzkvjwxpqhtrkzvbnmwqjxkz"
    docs = documents(spark, [f"use {run} now"])
    assert secret_scan.scan_secrets(docs, RANKS).first().spans == f"random:4:{4 + len(run)}"
    assert secret_scan.redact_secrets(docs, RANKS).first().text == "use [random removed] now"
