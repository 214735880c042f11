"""The pipeline's stages against plain checks of what each of them was given."""

import pytest

import corpus_pipeline
from boxquery.llm.suffixes import words_of
from boxquery.session import written


def shingles(text):
    words = text.encode().lower().split()
    size = min(5, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if words else set()


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, sf_dir), "test-stage")
        out.append((docs, after))
        docs = after
    return out


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_columns_stay_until_the_last_stage(steps):
    for before, after in steps[:3]:
        assert after.dtypes == before.dtypes
        kept, given = {tuple(r) for r in after.collect()}, {tuple(r) for r in before.collect()}
        assert kept <= given


def test_toxic_documents_go(steps, spark, sf_dir):
    kept = set(rows(steps[0][1]))
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = [i for i, t in toxic.items() if not t]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)


def test_most_toxic_documents_go(spark):
    folder = "/root/testdata/sf0.1"  # smaller tables have too few confirmed examples to learn from
    kept = set(rows(corpus_pipeline.drop_toxic(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)))
    known = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    toxic, clean = ([i for i, t in known.items() if t == label] for label in (1, 0))
    assert toxic and sum(i not in kept for i in toxic) >= 0.8 * len(toxic) and sum(i in kept for i in clean) >= 0.98 * len(clean)


def test_one_of_each_group_stays(steps):
    given, kept = rows(steps[1][0]), rows(steps[1][1])
    sets = {i: shingles(t) for i, t in given.items()}
    for i in given:
        near = [j for j in given if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
        if not near:
            assert i in kept
        assert not (i in kept and any(j in kept for j in near))


def test_contaminated_documents_go(steps, spark, sf_dir):
    given, kept = rows(steps[2][0]), rows(steps[2][1])
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        seq = words_of(r["text"].encode())
        windows |= {tuple(seq[s : s + min(13, len(seq))]) for s in range(max(1, len(seq) - 12))}
    sizes = {len(w) for w in windows if w}
    for i, text in given.items():
        words, hit = words_of(text.encode()), set()
        for size in sizes:
            for at in range(len(words) - size + 1):
                if tuple(words[at : at + size]) in windows:
                    hit.update(range(at, at + size))
        assert (i in kept) == (not hit or 20 * len(hit) < len(words))


def test_every_document_left_is_encoded(steps):
    given, out = rows(steps[3][0]), {r["doc_id"]: r for r in steps[3][1].collect()}
    assert set(out) == set(given)
    assert all(r["round_trip"] and r["n_pieces"] == len(r["ids"]) for r in out.values())


def test_run_gives_the_last_stage_s_rows(spark, sf_dir, steps):
    got = {tuple(r["ids"]) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == {tuple(r["ids"]) for r in steps[3][1].collect()}


DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, component_id int, print bigint"


def stored(spark, folder, documents, benchmark, labels):
    spark.createDataFrame([(*d, "en", "s", 1, "clash", 1, 2) for d in documents], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_strange_rows_through_run(spark, tmp_path):
    """Nulls, empty and repeated rows, ties and extra columns: near copies go, all else comes out encoded."""
    plain = [(i, " ".join(f"d{i}w{j}" for j in range(30))) for i in range(20)]
    long = (50, " ".join(f"long{j % 9973}" for j in range(60_000)))
    passage = " ".join(f"item{j}" for j in range(20))
    odd = [(60, None), (61, ""), (62, " \n"), (None, "a text whose row has no id"), (63, "short"), (64, passage), (65, "before " + passage)]
    rows = [*plain, plain[3], (70, plain[4][1]), (71, plain[5][1] + " one more word"), long, *odd]
    folder = stored(spark, tmp_path, rows, [(1, passage), (2, None), (None, "")], [(0, 1, 1), (1, 1, 0), (2, None, None), (None, 0, 1)])
    found = corpus_pipeline.run(spark, folder)
    assert [name for name, _ in found.dtypes] == ["doc_id", "n_pieces", "score", "ids", "round_trip"]
    ids = sorted((r["doc_id"] is None, r["doc_id"]) for r in found.collect())
    # 60 to 62 have no words and are one group; 70 and 71 are near copies; 64 and 65 hold a passage; row 3 comes twice
    assert ids == sorted([(False, i) for i in [*range(20), 3, 50, 60, 63]] + [(True, None)])


def test_empty_tables_through_run(spark, tmp_path):
    assert corpus_pipeline.run(spark, stored(spark, tmp_path, [], [], [])).collect() == []
