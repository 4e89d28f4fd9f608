"""Invariants that hold at any size."""

from hypothesis import given, settings
from hypothesis import strategies as st

from skeinlake.functions import chunking
from skeinlake.functions.text import glob_regex
from skeinlake.sources import files


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n?!é", max_size=600), st.integers(20, 90), st.integers(0, 15))
def test_chunks_cover_any_text(text, size, overlap):
    parts = list(chunking.chunks(text, size, overlap))
    at = 0
    for a, part in parts:
        assert a <= at and text[a : a + len(part)] == part and len(part) <= size
        at = a + len(part)
    assert at == len(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="# -`ab\n1.", max_size=900))
def test_fragments_never_fail(text):
    found = list(chunking.fragments(text))
    assert found[0] == ("full", None, text, 1) and len(found) <= chunking.MOST_FRAGMENTS
    assert all(chunking.LEAST_FRAGMENT <= len(f[2]) <= chunking.MOST_FRAGMENT for f in found[1:])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=200), st.integers(1, 80))
def test_truncation(text, most):
    out = chunking.truncate(text, most)
    assert len(out) <= most + 1 and text.startswith(out)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet='{}[]":,abUuser \n', max_size=200))
def test_any_text_is_a_conversation_or_none(text):
    assert isinstance(files.messages(text), list)


@given(st.text(alphabet="ab/.*?{},", max_size=20))
def test_globs_compile(glob):
    import re

    re.compile(glob_regex(glob))
