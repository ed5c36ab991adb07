"""The hashed kernels against plain Python."""
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from tidepanel.llm import decontaminate  # noqa: F401  the package imports
from tidepanel.llm.line_dedup import windows
from tidepanel.llm.quality import statistics
from tidepanel.llm.text import buffers, shingle_sets

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="abA é#\n\t日|", max_size=60)), max_size=6)


def arrays(texts):
    return buffers(pa.array(texts, pa.string()))


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_counts_of_quality(texts):
    got = statistics(*arrays(texts))
    for text, row in zip(texts, got):
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert row[:5].tolist() == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
                                    len({i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)})]


@settings(max_examples=80, deadline=None)
@given(TEXTS)
def test_shingle_sets_have_the_right_sizes_and_overlaps(texts):
    def brute(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, want = shingle_sets(*arrays(texts)), [brute(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(sets)):
        for j in range(i):
            assert len(np.intersect1d(sets[i], sets[j])) == len(want[i] & want[j])


def test_windows_of_lines_are_the_shortest_with_enough_words():
    text = "a b\n\nc\nd e f\ng"
    found = windows(*arrays([text]), least=3)
    assert {(int(s), int(s + n)) for s, n in zip(found["start"], found["size"])} == {(0, 3), (2, 4), (3, 4), (3, 5)}


def thue_morse(letters, n=1024):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


def test_words_of_the_same_letters_in_another_order_differ(spark):
    """Thue-Morse words and their mirror images collide in every sum of powers modulo 2^64."""
    from tidepanel.llm.line_dedup import dedup_lines
    from tidepanel.llm.ngram_join import jaccard_components
    from tidepanel.llm.text import EXACT, EXACT_2, LOWER, span_hashes

    a, b = thue_morse("ab"), thue_morse("ba")
    data = np.frombuffer((a + b).encode(), np.uint8)
    for values in (EXACT, EXACT_2, LOWER):
        one, other = span_hashes(data, np.array([0, 1024]), np.array([1024, 2048]), values)
        assert one != other
    start = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"{start} {a}"), (2, f"{start} {b}"), (3, f"{start} {a}")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs).collect()} == {1: f"{start} {a}", 2: f"{start} {b}", 3: ""}
    short = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_components(short).collect()} == {1: 1, 2: 2, 3: 1}


def test_long_training_texts_are_cut_to_their_share(spark):
    """A language with one endless document learns from its beginning only; what it predicts of others still works."""
    from tidepanel.llm import langid

    docs = [(1, "der die das und nicht mit ein eine " * 40_000, "de"), (2, "the and of with not a an is " * 40, "en")]
    frame = spark.createDataFrame([(i + 3, t, x) for i, t, x in docs] + [(i + 7, t, x) for i, t, x in docs], "doc_id long, text string, lang string")
    automata = langid.train(frame)
    got = langid.identify(spark.createDataFrame([(1, "und das mit der"), (2, "not the and of")], "doc_id long, text string"), automata).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {1: "de", 2: "en"}
