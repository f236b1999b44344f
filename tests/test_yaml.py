import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.sources import yamls as Y

TEXT = """
# settings
name: "a: b"   # note
port: 8080
ratio: 0.5
on: true
none: ~
base: &b
  x: 1
  y: [1, 'two', {z: 3}]
list:
- a
- b: 1
  c: 2
-
  - 1
  - 2
derived:
  <<: *b
  x: 9
text: |
  line one
    line two
folded: >-
  one
  two
url: http://x.y/z
"""


def test_document():
    d = Y.load(TEXT)
    assert d["name"] == "a: b" and d["port"] == 8080 and d["ratio"] == 0.5 and d["on"] is True and d["none"] is None and d["url"] == "http://x.y/z"
    assert d["base"] == {"x": 1, "y": [1, "two", {"z": 3}]} and d["list"] == ["a", {"b": 1, "c": 2}, [1, 2]] and d["derived"] == {"x": 9, "y": [1, "two", {"z": 3}]}
    assert d["text"] == "line one\n  line two\n" and d["folded"] == "one two"


def test_several_documents_and_errors():
    assert Y.load_all("a: 1\n---\n- 2\n---\nx") == [{"a": 1}, [2], "x"] and Y.load("") is None
    for bad in ("a: 1\na: 2", "a: [1", "a:\n\t- 1", "a: *none"):
        with pytest.raises((Y.YamlError, ValueError)):
            Y.load(bad)


plain = st.none() | st.booleans() | st.integers(-100, 100) | st.text("abc :#-'\"\\é,", max_size=6)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.text("abx y", min_size=1, max_size=4), st.recursive(plain, lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text("kq", min_size=1, max_size=2), c, max_size=3), max_leaves=6), min_size=1, max_size=4))
def test_round_trip(value):
    assert Y.load(Y.dump(value)) == value
