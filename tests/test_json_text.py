"""The one-pass scanner of JSON values against a decoder that starts anew at each bracket."""

import json
import random
import time

import pytest

from auditspark.functions.json_text import values_in

PARTS = ["{", "}", "[", "]", ",", ":", '"', '"a"', '"k":', "1", "-2.5e3", "true", "null", "NaN", " ", "\\", "x", '"\\u00e9"', '"[1]"', "Infinity", "-", '"\\""', "01", "\n", '{"a":1}', "[]", "\ufeff", "\x01", '{"a":{"a":2},"a":[[]]}']


def by_decoder(text):
    decoder, found = json.JSONDecoder(), []
    for at, c in enumerate(text):
        if c in "{[":
            try:
                value, end = decoder.raw_decode(text, at)
            except ValueError:
                continue
            found.append((at, end, value))
    return found


def test_values_equal_the_decoder():
    rng = random.Random(0)
    for _ in range(20_000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randrange(1, 14)))
        assert repr(values_in(text)) == repr(by_decoder(text)), text


@pytest.mark.parametrize("text, found", [("[" * 500_000 + "]" * 500_000, 500_000), ("[" * 1_000_000, 0), ("{" * 1_000_000, 0), ('{"a":' * 150_000 + "1" + "}" * 150_000, 150_000), ('["[' * 300_000, 0), ('"[1]"' * 200_000, 200_000), ('{"a": "[", ' * 90_000, 0)])
def test_long_texts(text, found):
    began = time.process_time()
    assert len(values_in(text)) == found
    assert time.process_time() - began < 15
