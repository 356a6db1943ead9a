"""The pipeline's stages on a small fixture, each held against brute force on its own input."""

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

import corpus_pipeline
from emberlog.llm import pieces
from emberlog.session import work_path

WORDS = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


@pytest.fixture(scope="module")
def folder(spark):
    rng = np.random.default_rng(8)
    say = lambda n: " ".join(rng.choice(WORDS, n))
    base, passage = say(120).split(), say(40)
    texts = [say(int(rng.integers(30, 150))) for _ in range(40)]
    for i in range(12):                                   # near copies of one text
        copy = list(base)
        copy[10 * i % 120] = "changed"
        texts.append(" ".join(copy))
    texts += [texts[3], texts[3], "12345 67890 !!", "", None, f"{say(10)} {passage} {say(5)}", f"{say(900)} {passage}",
              f"{say(30)} password = abcdef0123456789xyz {say(20)}", f"{say(30)} {'Ab9' * 10} {say(20)}"]
    docs = [(i, t, "en", f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    path = work_path(spark, "fixture")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        path = work_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        kept[name] = (before, {r.doc_id: r for r in docs.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = kept["language ID"]
    assert set(before) - set(after) == {i for i, r in before.items() if not any(c.isalpha() for c in r.text or "")}
    before, after = kept["n-gram Jaccard join"]
    sets, root = {i: shingles(r.text) for i, r in before.items()}, {i: i for i in before}
    for _ in before:
        for i in before:
            for j in before:
                c = len(sets[i] & sets[j])
                if c and 100 * c >= 80 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert set(after) == {i for i in before if root[i] == i} and len(after) < len(before) - 10
    before, after = kept["benchmark decontamination"]
    passage = spark.read.parquet(f"{folder}/benchmark.parquet").first().text.split()
    windows = {tuple(passage[i:i + 13]) for i in range(len(passage) - 12)}

    def contaminated(text):
        w = text.lower().split()
        hit = {p for i in range(len(w) - 12) if tuple(w[i:i + 13]) in windows for p in range(i, i + 13)}
        return bool(hit) and 20 * len(hit) >= len(w)

    assert set(before) - set(after) == {i for i, r in before.items() if contaminated(r.text)} != set()
    before, after = kept["secret scans"]
    changed = {i for i in before if before[i].text != after[i].text}
    assert set(before) == set(after) and len(changed) == 2
    assert any("password = [assign]" in after[i].text for i in changed) and any("[owned]" in after[i].text for i in changed)
    before, after = kept["SentencePiece encoding and decoding"]
    library = SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(before) == set(after)
    for i, r in after.items():
        assert r.round_trip and r.ids == library.encode(before[i].text) and r.n_tokens == len(r.ids)


def test_run_equals_the_stages_in_a_row(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    rows = lambda df: sorted(map(repr, df.collect()))
    assert rows(corpus_pipeline.run(spark, folder)) == rows(docs)


def test_an_empty_table_passes_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        path = work_path(spark, "stage")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() == 0
