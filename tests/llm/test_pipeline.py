"""The corpus pipeline, stage by stage, against plain versions of what each stage decides."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from strandwork.llm import pii, toxicity
from strandwork.llm.shared import kept, read
from tests.llm.test_near import brute
from tests.llm.test_text_operators import added_spans, base_spans, tokens


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = kept(stage(spark, docs, sf), name)
        steps[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != "bpe":
            assert docs.columns == columns
    before, after = steps["toxicity"]
    net = toxicity.fit(read(spark, sf, "documents"), read(spark, sf, "labels"))
    scores = toxicity.Scorer(net).scores([r.text.encode() for r in before.values()])
    assert set(after) == {i for i, s in zip(before, scores) if s < toxicity.THRESHOLD}
    before, after = steps["simhash_dedup"]
    copies = brute([(i, r.text) for i, r in before.items()])
    assert set(after) == set(before) - set(copies)
    before, after = steps["decontaminate"]
    items = [tokens(r.text) for r in read(spark, sf, "benchmark").collect()]
    grams = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in grams for n in {len(g) for g in grams} for k in range(len(w) - n + 1))
    assert set(after) == {i for i, r in before.items() if not hit(tokens(r.text))} and len(after) < len(before)
    before, after = steps["pii"]
    assert {i: r.text for i, r in after.items()} == {i: plainly_masked(r.text) for i, r in before.items()}
    assert all(r.n_chars == len(r.text) for i, r in after.items() if r.text != before[i].text)
    before, after = steps["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, r in after.items():
        assert r.round_trip and len(r.ids) == r.n_tokens and list(r.ids) == library.encode(before[i].text or "", add_special_tokens=False).ids
    assert set(after) == set(before)


def plainly_masked(text):
    """The text with each stretch of personal data replaced by its first kind, by the regular expressions of the other test."""
    found = sorted(base_spans(text) + added_spans(text), key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))
    out, at = "", 0
    for start, end, kind in found:
        if start >= at:
            out += text[at:start] + f"<{kind}>"
        at = max(at, end)
    return out + text[at:]


def test_odd_rows(spark, sf):
    docs = spark.createDataFrame(
        [(1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "a b c", None, None, 5), (3, "a b c", None, None, 5), (None, "d e f", "en", "s", 5)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
        got = stage(spark, docs, sf)
        if name == "simhash_dedup":
            assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 1, 3]
        else:
            assert got.count() == 5
