"""Operator 2 against a plain loop over all runs in document order."""

import random

from conftest import SF01
from fedsearch.llm import queries, span_dedup as S


def brute(docs):
    """docs: (doc_id, text) in order; the expected (text, removed, sentences) of each."""
    seen, out = set(), []
    for _, text in docs:
        places = [m.start() for m in S._WORD.finditer(text)] + [len(text)]
        words = [text[a:b].strip() for a, b in zip(places, places[1:])]
        own, first = S.split(text)
        levels = [list(map(int, x)) for x in S.borders(S.hashed(own), first)]
        own = {(a, min(e for e in at if e >= a + S.MIN_WORDS)) for at in levels for a in at if a + S.MIN_WORDS <= len(words)}
        gone = [False] * len(words)
        for a, b in sorted(own):
            run = tuple(words[a:b])
            if run in seen:
                gone[a:b] = [True] * (b - a)
            seen.add(run)
        first = levels[0]
        out.append((text[:places[0]] + "".join(text[places[i]:places[i + 1]] for i in range(len(words)) if not gone[i]),
                    sum(any(gone[a:b]) for a, b in zip(first, first[1:])), len(first) - 1))
    return out


def test_query(spark, documents):
    docs = sorted((d, r.text) for d, r in documents.items())
    want = {d: w for (d, _), w in zip(docs, brute(docs))}
    got = {r.doc_id: (r.text, r.n_removed, r.n_sentences) for r in queries.op2_span_dedup(spark, SF01).collect()}
    assert got == want
    assert sum(w[1] > 0 for w in want.values()) > 50


def sentences(text):
    own, first = S.split(text)
    words = S._WORD.findall(text)
    assert own == words and first[-1] == len(S.hashed(own)) == len(words)
    return [words[a:b] for a, b in zip(first, first[1:])]


def test_sentences():
    assert sentences("") == sentences(" \n ") == []
    assert sentences("One. Two!  Three?\n\nFour more") == [["One."], ["Two!"], ["Three?"], ["Four", "more"]]
    assert sentences("3.14 is pi. ok\r\nb") == [["3.14", "is", "pi."], ["ok"], ["b"]]
    assert sentences("你好。再见！ 好 \x1c a\x85b ") == [["你好。"], ["再见！"], ["好", "a", "b"]]
    assert S.remove("  a b. c", [{"start": 0, "size": 2}]) == ("  c", 1, 2)


def test_run_hashes_are_those_of_the_words():
    words = [f"w{i % 7}" for i in range(200)]
    own, first = S.split(" ".join(words))
    h = S.hashed(own)
    start, end = S.runs(h, first)
    names = {}
    for a, b, x, y in zip(start, end, *S._run_hashes(h, start, end, S._powers(len(h)))):
        assert names.setdefault((x, y), words[a:b]) == words[a:b]
    assert len(names) == len({tuple(words[a:b]) for a, b in zip(start, end)})


def test_repeat_inside_a_document_and_clean_documents(spark):
    passage = "We met the captain at dawn near the old stone pier. He told us of storms and of the long way home to the north. "
    other = "Nothing in this text is found in any of the others that stand beside it here. It is short, but long enough to hold a run. "
    docs = spark.createDataFrame([(1, passage + "Alone. " + passage), (2, other), (3, "Before. " + passage + "After.")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed) for r in S.dedup(docs).collect()}
    assert got[1] == (passage + "Alone. ", 2) and got[2] == (other, 0) and got[3] == ("Before. After.", 2)


def windows(text, n=50):
    words = text.split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def test_no_window_of_fifty_words_is_left(spark, documents):
    """Passages of 50 to 80 words planted in unmarked text, inside long sentences and with other marks."""
    rng = random.Random(3)

    def prose(n):
        return [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]

    docs, planted = [], [prose(rng.randint(50, 80)) for _ in range(100)]
    for k, passage in enumerate(planted * 3):
        mark = rng.choice(["", "", ".", "。"])
        docs.append((k, " ".join(prose(rng.randint(0, 90)) + [passage[0]] + [w + mark * (i % 17 == 16) if not mark else w
                                 for i, w in enumerate(passage[1:])] + prose(rng.randint(0, 90)))))
    clean = [(1000 + k, " ".join(prose(120))) for k in range(50)]
    got = {r.doc_id: r.text for r in S.dedup(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()}
    assert all(got[d] == text for d, text in clean + docs[:100])
    left = sum(bool(windows(" ".join(p)) & windows(got[k])) for k, p in enumerate(planted * 3) if k >= 100)
    assert left <= 2


def test_no_window_of_fifty_words_is_left_in_the_table(spark, documents):
    seen, left = set(), 0
    texts = {r.doc_id: r.text for r in queries.op2_span_dedup(spark, SF01).collect()}
    for d in sorted(texts):
        own = windows(texts[d] or "")
        left += bool(own & seen)
        seen |= own
    assert left <= 1


def test_edges(spark, edge, none, clashing):
    rows = S.dedup(edge).collect()
    assert len(rows) == edge.count()
    assert all(r.text == "" and r.n_sentences == 0 for r in rows if r.doc_id == 3)
    assert all(r.text is None for r in rows if r.doc_id == 2)
    assert len({(r.text, r.n_removed) for r in rows if r.doc_id == 6}) == 1
    assert S.dedup(none).count() == 0
    out = S.dedup(clashing)
    assert set(out.columns) == set(clashing.columns) | {"n_sentences"}
    assert {r.key for r in out.collect()} == {"own key"}
