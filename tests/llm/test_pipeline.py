"""The pipeline's stages on small tables, each against a plain version on its own input."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from scriptorium.llm import common

from .cases import documents, prose
from .test_operators import brute_components, brute_exact, brute_fingerprint

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "secrets", "packing"]


def test_toxic_documents_go_and_clean_ones_stay(spark, tmp_path):
    clean = [(i, prose(i, 60)) for i in range(200)]
    toxic = [(1000 + i, prose(i + 7000, 40) + " idiot " + prose(i + 8000, 9) + " pathetic scum") for i in range(60)]
    spark.createDataFrame([(i, 0) for i, _ in clean] + [(i, 1) for i, _ in toxic], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.reject_toxic(spark, table(spark, clean + toxic), str(tmp_path))
    assert out.columns == COLUMNS
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in clean}


def test_copies_and_near_copies(spark):
    docs = table(spark, documents())
    out = corpus_pipeline.drop_copies(spark, docs, "")
    assert out.columns == COLUMNS and out.count() == brute_exact(documents())[1]
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    rows = [r for r in documents() if r[0] is not None]
    want = set(brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows]))
    assert near.columns == COLUMNS
    assert {r["doc_id"] for r in near.collect() if r["doc_id"] is not None} == want


def test_near_copies_are_all_pairs_alike_by_four_fifths_of_their_shingles(spark):
    def shingled(text):
        found = (text or "").lower().split()
        return {" ".join(found[i : i + 5]) for i in range(max(1, len(found) - 4))}

    r = random.Random(5)
    rows = [row for row in documents() if row[0] is not None]
    for i in range(60):  # chains of copies, each with more words changed
        words = [f"w{r.randrange(400)}" for _ in range(40 + i)] + ["a", "very", "common", "last", "line", "of", "words"]
        for j in range(4):
            rows.append((1000 + 10 * i + j, " ".join(words)))
            for at in r.sample(range(len(words)), 1 + i % 3):
                words[at] = f"x{r.randrange(400)}"
    sets = [shingled(t) for _, t in rows]
    root = list(range(len(rows)))
    top = lambda i: i if root[i] == i else top(root[i])
    near = [(i, j) for j in range(len(rows)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    for i, j in near:
        root[top(j)] = top(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    far = [(i, j) for i, j in near if bin(brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[j][1])).count("1") > 2]
    assert len(far) > 20
    got = corpus_pipeline.drop_near_copies(spark, table(spark, rows), "")
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_stages_leave_only_the_scratch_tables_that_their_results_read(spark):
    from pathlib import Path

    from scriptorium.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        before = {p.name for p in folder.iterdir()}
        out = stage(spark, table(spark, documents()), "")
        left = {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before}
        assert left == {"numbered", "gone", "filter"}
        assert out.count() > 0


def test_stages_do_not_copy_stored_input(spark, tmp_path):
    from pathlib import Path

    from scriptorium.session import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file://"))
    copied = table(spark, documents())
    copied.repartition(5).write.parquet(f"{tmp_path}/docs.parquet")
    stored = spark.read.parquet(f"{tmp_path}/docs.parquet")
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies):
        before = {p.name for p in folder.iterdir()}
        out = stage(spark, stored, "")
        left = {p.name.rpartition("-")[0] for p in folder.iterdir() if p.name not in before}
        assert left == {"gone", "filter"}
        ids = lambda rows: sorted(str(r["doc_id"]) for r in rows.collect())
        assert out.columns == COLUMNS and ids(out) == ids(stage(spark, copied, ""))


def test_numbers_of_stored_rows_do_not_depend_on_the_splits(spark, tmp_path):
    path = f"{tmp_path}/n.parquet"
    spark.range(20_000).selectExpr("id", "'x' as _metadata", "sha2(string(id), 256) as path").repartition(6).write.parquet(path)
    numbers = lambda df: {r["id"]: r["row"] for r in common.numbered(df, "row").collect()}
    want = numbers(spark.read.parquet(path))
    assert len(set(want.values())) == 20_000
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        assert numbers(spark.read.parquet(path)) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    twice = common.numbered(spark.read.parquet(path, path), "row")
    assert twice.count() == twice.select("row").distinct().count()
    part = common.numbered(spark.read.parquet(path).where("id < 50"), "row")
    assert part.count() == part.select("row").distinct().count() == 50


def test_secrets_are_masked_and_clean_documents_unchanged(spark):
    rows = documents()
    out = corpus_pipeline.mask_secrets(spark, table(spark, rows), "").collect()
    assert len(out) == len(rows)
    for r in out:
        assert not re.search(r"[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r["text"] or "")
        if r["doc_id"] is not None and r["doc_id"] < 300:
            assert (r["doc_id"], r["text"]) in rows
        if r["text"] is not None:
            assert r["n_chars"] == len(r["text"])


def labelled(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_take_empty_tables_and_columns_of_any_name(spark, tmp_path):
    sf = labelled(spark, tmp_path, [(1, 0)])
    names = ["score", "row", "secret_spans", "bits", "base", "kept", "fp"]
    rows = [(1, "plain words here"), (2, None), (2, None), (3, ""), (None, "x y z"), (4, "long " * 30_000)]
    schema = "doc_id long, text string, " + ", ".join(f"{n} string" for n in names)
    full = spark.createDataFrame([(i, t, *names) for i, t in rows], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, full, sf)
        assert out.columns == full.columns, name
        kept = out.collect()
        assert kept and all(tuple(r[n] for n in names) == tuple(names) for r in kept)
        assert {r["doc_id"] for r in kept} >= {1, 4}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, full.where("false"), sf).count() == 0


def test_toxic_rows_without_labels_nulls_and_long_texts(spark, tmp_path):
    sf = labelled(spark, tmp_path, [(7, None)])
    docs = table(spark, [(1, None), (1, None), (2, ""), (3, "idiot " * 20_000)])
    assert corpus_pipeline.reject_toxic(spark, docs, sf).count() == 4  # nothing to learn from: all stay


def test_packed_documents_hold_every_id_once(spark):
    from scriptorium.llm import packing

    rows = [(i, prose(i, 40 * i)) for i in range(60)] + [(100, None), (101, ""), (102, "y " * 9000)]
    got = corpus_pipeline.pack(spark, table(spark, rows), "").collect()
    encode = packing.Encoder(packing.default_tokenizer())
    sizes = {i: len(encode(t or "")) // 4 + 1 for i, t in rows}
    assert {i: sum(r["length"] for r in got if r["doc_id"] == i) for i in sizes} == sizes
    used = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert used.get(r["sequence_id"], 0) == r["offset"]
        used[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(used.values()) <= 2048 and sorted(used) == list(range(len(used)))


def test_the_pipeline_runs_whole(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    assert 0 < out.select("doc_id").distinct().count() <= common.table(spark, sf, "documents").count()
