"""The pipeline: every stage against a plain version of its decisions on its own input."""

import pytest
import sentencepiece

import __spark_entry__ as entry
import corpus_pipeline as C
from conftest import SF01
from fedsearch.llm import mixing, pii, piece_tokens, quality
from llm.test_quality import rules
from llm.test_simhash_dedup import fingerprint, groups


@pytest.fixture(scope="module")
def stages(spark):
    """Input of each stage, and the result."""
    docs, out = C.table(spark, SF01, "documents"), []
    for name, stage in C.STAGES:
        out.append(docs)
        docs = C.stored(stage(spark, docs, SF01), "test-stage")
    return [*out, docs]


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["quality rules", "SimHash near-dedup", "PII", "mixing sources to target weights",
                                        "SentencePiece encoding and decoding"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality(spark, stages):
    before, after = rows(stages[0]), rows(stages[1])
    judged = {r.doc_id: r for r in quality.judge(stages[0], C.table(spark, SF01, "labels")).collect()}
    assert set(after) == {d for d, r in judged.items() if not rules(before[d].text)[5] and r.score >= quality.THRESHOLD}
    assert all(after[d] == before[d] for d in after)


def test_near_dedup(stages):
    before, after = rows(stages[1]), rows(stages[2])
    names = groups({d: fingerprint(r.text) for d, r in before.items()})
    assert set(after) == set(names.values()) and all(after[d] == before[d] for d in after)


def test_redaction(stages):
    before, after = rows(stages[2]), rows(stages[3])
    assert set(before) == set(after)
    for r in pii.find(stages[2]).collect():
        text, at, out = r.text, 0, []
        for s in r.spans:
            if s.end > at:
                out += [text[at:max(s.start, at)], f"<{s.kind.upper()}>"]
                at = s.end
        assert after[r.doc_id].text == "".join(out) + text[at:]
        assert after[r.doc_id].n_chars == len(after[r.doc_id].text)


def test_mix(stages):
    taken = {r.doc_id: r.taken for r in mixing.mix(stages[3]).collect()}
    words = {}
    for r in stages[4].collect():
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.encode().split())
    assert words == {d: n for d, n in taken.items() if n}


def test_encoding(stages):
    other = sentencepiece.SentencePieceProcessor(model_file=piece_tokens.MODEL)
    want = sorted((r.doc_id, other.encode(r.text)) for r in stages[4].collect())
    assert sorted((r.doc_id, r.ids) for r in stages[5].collect()) == want
    assert all(r.same_text and r.n_tokens == len(r.ids) for r in stages[5].collect())


def test_run_and_registration(spark, stages):
    names = entry.queries()
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in names} and "pipeline" in names
    got = names["pipeline"](spark, SF01)
    assert sorted((r.doc_id, r.ids) for r in got.collect()) == sorted((r.doc_id, r.ids) for r in stages[5].collect())


def test_empty_documents(spark, none, no_labels, monkeypatch):
    monkeypatch.setattr(C, "table", lambda s, d, name: no_labels if name == "labels" else none)
    assert C.run(spark, "nowhere").count() == 0
