import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from texts import ODD, prose

from hindcast.llm import substrings
from hindcast.llm.substrings import SuffixAutomaton, cut_repeats


def brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + width]) for _, w in words for k in range(len(w) - width + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if seen[tuple(w[k : k + width])] > 1:
                gone[k : k + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


Q = [f"q{i}" for i in range(90)]
ROWS = [
    *ODD,
    (11, " ".join(Q[:80])),
    (12, "x " + " ".join(Q[20:70]) + " y"),
    (13, "a " * 100),
    (14, "z " * 35),
    (15, "s " + prose(3, 200)),
    (16, prose(3, 200) + " t"),
    (16, prose(3, 200) + " t"),
    (17, " ".join(Q[40:90] + Q[:38])),
    (18, " ".join(Q[:34])),
]


@pytest.mark.parametrize("most", [2000, 2])
@pytest.mark.parametrize("width", [35, 12])
def test_against_brute_force(documents, monkeypatch, most, width):
    monkeypatch.setattr(substrings, "MOST_PLACES", most)
    got = cut_repeats(documents(ROWS, 3), width, with_text=True).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, width)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.integers(0, 1), min_size=3, max_size=9), min_size=1, max_size=8))
def test_counting_agrees_with_the_automaton(sequences):
    pieces = [np.array(s, np.uint64).tobytes() for s in sequences]
    times = {p: pieces.count(p) for p in pieces}
    assert substrings._counted_windows(times, 3) == substrings.repeated_windows(pieces, 3)


def test_no_rows(documents):
    assert cut_repeats(documents(ODD[:1]).limit(0)).count() == 0


def test_width_has_bounds(documents):
    with pytest.raises(ValueError):
        cut_repeats(documents(ODD[:1]), 100)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.lists(st.integers(0, 2), max_size=12), max_size=5), st.integers(1, 4))
def test_automaton_counts(sequences, width):
    automaton = SuffixAutomaton()
    for s in sequences:
        automaton.add(s, 2)
    automaton.close()
    count = Counter(tuple(s[i : i + width]) for s in sequences for i in range(len(s) - width + 1))
    for s in [*sequences, [0, 1, 2, 3, 0, 0]]:
        for end, (matched, state) in enumerate(automaton.matches(s)):
            longest = max(n for n in range(end + 2) if n == 0 or any(s[end + 1 - n : end + 1] == t[i : i + n] for t in sequences for i in range(len(t))))
            assert matched == longest
            if matched >= width:
                assert automaton.occurrences(matched, state, width) == 2 * count[tuple(s[end + 1 - width : end + 1])]
