from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_simhash import groups, plain
from tests.llm.test_text_ops import deduped
from tidemark.llm.q_bpe import vocabulary
from tidemark.runtime import table

SF = "/root/testdata/sf0.01"


def test_every_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "line dedup", "near dedup", "mixing", "encoding"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}

    kept = table(stages["quality rules"](spark, docs, SF))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    words = {r.doc_id: len(r.text.split()) for r in docs.collect()}
    good = [i for i, q in labels.items() if q == 1 and words[i] >= 60]
    assert sum(i in ids for i in good) >= 0.97 * len(good)
    assert not any(i in ids for i, q in labels.items() if q == 0)

    lined = table(stages["line dedup"](spark, kept, SF))
    assert lined.columns == docs.columns
    before, after = ({r.doc_id: r.text for r in d.collect()} for d in (kept, lined))
    assert after == {i: t for i, t, _, _ in deduped(list(before.items()))} and after != before

    alone = table(stages["near dedup"](spark, lined, SF))
    assert alone.columns == docs.columns
    want = groups({i: plain(t) for i, t in after.items()})
    assert sorted(r.doc_id for r in alone.select("doc_id").collect()) == sorted(set(want.values()))

    mixed = table(stages["mixing"](spark, alone, SF))
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.select("doc_id").collect())
    assert set(times.values()) <= {1, 2}

    lib = Tokenizer.from_file(vocabulary())
    out = stages["encoding"](spark, mixed, SF).collect()
    assert Counter(r.doc_id for r in out) == times and all(r.round_trip for r in out)
    text = {r.doc_id: r.text for r in mixed.collect()}
    for r in out[:100]:
        assert np.frombuffer(r.ids_le, "<u4").tolist() == lib.encode(text[r.doc_id], add_special_tokens=False).ids


def test_near_dedup_keeps_unlike_texts_of_one_id(spark):
    words = lambda k: " ".join(f"{chr(97 + (i * k) % 26)}{(i * i * k) % 97}" for i in range(200))
    rows = [(1, words(3)), (5, words(3)), (5, words(7)), (5, words(7)), (5, words(11)), (2, words(11)), (5, words(13)), (6, None), (None, words(3)), (None, words(3))]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = dict(corpus_pipeline.STAGES)["near dedup"](spark, docs, SF)
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(1, words(3)), (5, words(7)), (5, words(13)), (2, words(11)), (6, None)], key=repr)


CLASH = ["n_words", "size", "_row", "_key", "level", "copies", "distance", "kept", "pos", "fp", "n_lines", "target"]


def test_stages_on_odd_rows(spark):
    rng = np.random.default_rng(3)
    text = lambda: "\n".join(" ".join("".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(12)) for _ in range(8))
    rows = [(i, text(), "en", f"s{i % 2}") for i in range(30)] + [(None, text(), None, None), (40, None, "en", "s0"), (41, "", None, "s1"), (42, "one word", "en", None)]
    rows += [(50, rows[0][1], "en", "s0"), (51, rows[1][1], "en", "s1"), (51, rows[1][1], "en", "s1"), (None, rows[2][1], "en", "s0")]
    d = spark.createDataFrame([(*r, len(r[1] or ""), *range(len(CLASH))) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASH))
    stages = dict(corpus_pipeline.STAGES)
    docs, n = d, {}
    for name in list(stages)[:-1]:
        docs = table(stages[name](spark, docs, SF))
        assert docs.columns == d.columns
        got = docs.collect()
        n[name] = len(got)
        assert all([getattr(r, c) for c in CLASH] == list(range(len(CLASH))) for r in got)
        assert all(r.n_chars == len(r.text or "") for r in got)
        assert stages[name](spark, d.where("false"), SF).count() == 0
    # without a text or with few words: rejected; copies, one without an id, and the repeated row: one stays
    assert n["quality rules"] == n["line dedup"] == 35 and n["near dedup"] == 31
    out = stages["encoding"](spark, docs, SF).collect()
    assert len(out) == n["mixing"] and all(r.round_trip for r in out)
    assert stages["encoding"](spark, d, SF).count() == len(rows) and stages["encoding"](spark, d.where("false"), SF).count() == 0
    # null and empty texts through the stages that don't reject them
    assert stages["line dedup"](spark, d, SF).where("text is null").count() == 1
    assert stages["near dedup"](spark, d, SF).where("coalesce(text, '') = ''").count() == 1
    assert stages["mixing"](spark, d, SF).where("coalesce(text, '') = ''").count() == 2


def test_run_is_its_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = table(stage(spark, docs, SF)) if name != "encoding" else stage(spark, docs, SF)
    want = sorted((r.doc_id, r.n_tokens) for r in docs.collect())
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == want and all(r.round_trip for r in got)
