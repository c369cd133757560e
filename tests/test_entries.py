"""Saving, indexes, streams and migrations on small cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import fulltext as S
from scriptorium.operators import retrieval as R
from scriptorium.operators import saving
from scriptorium.plans.saving import FIRST, SECOND, empty
from scriptorium.sources import migrations as M
from scriptorium.sources import pdf, pdf_writer
from scriptorium.streaming import changes as SC


def request(spark, *rows):
    full = [(n, url, title, "article", text, None, None, None, None, tags, "cli") for n, url, title, text, tags in rows]
    return spark.createDataFrame(full, saving.REQUEST)


def test_saving_finds_urls_and_makes_tags_once(spark):
    first = request(spark, (1, "http://Example.com/1", "one", "a b c", ["x", "y", "x"]), (2, "http://Example.com/1", "again", "d", ["z"]), (3, None, "none", "", []), (4, None, "none", "e", None))
    a = saving.stored(saving.saved(empty(spark), first, FIRST))
    rows = {r["title"]: r for r in a["entries"].collect()}
    assert a["entries"].count() == 3 and rows["one"]["domain"] == "example.com" and rows["one"]["word_count"] == 3
    assert sorted(r["index_status"] for r in a["entries"].collect()) == ["failed", "ok", "ok"]
    assert sorted(r["name"] for r in a["tags"].collect()) == ["x", "y"]
    b = saving.saved(a, request(spark, (1, "http://Example.com/1", "later", "t", ["new"]), (2, "http://b/", "b", "t", ["x"])), SECOND)
    assert b["entries"].count() == 4 and sorted(r["name"] for r in b["tags"].collect()) == ["x", "y"]


def test_an_unknown_id_is_an_error_and_edits_of_one_do_nothing(spark):
    a = saving.stored(saving.saved(empty(spark), request(spark, (1, None, "one", "text", ["x"])), FIRST))
    with pytest.raises(KeyError):
        saving.one(a["entries"], "nobody")
    gone = saving.deleted(a, spark.createDataFrame([("nobody",)], "id string"), SECOND)
    assert gone["entries"].count() == 1 and gone["tombstones"].count() == 0


def test_deleting_takes_all_that_is_an_entrys(spark):
    a = saving.stored(saving.saved(empty(spark), request(spark, (1, None, "one", "text", ["x"]), (2, None, "two", "text", ["x"])), FIRST))
    out = saving.deleted(a, a["entries"].where("title = 'one'").select("id"), SECOND)
    assert [out[t].count() for t in ("entries", "entry_content", "entry_tags", "tags", "tombstones")] == [1, 1, 1, 1, 1]
    marks = out["change_log"].where("col = '__tombstone__'").groupBy("tbl").count().collect()
    assert {r["tbl"] for r in marks} == {"entries", "entry_content", "entry_tags"}


def test_queries_are_parsed_like_the_search_box(spark):
    assert [(p.tokens, p.prefix) for p in S.parse("foo bar baz")] == [(("foo",), False), (("bar",), False), (("baz",), True)]
    assert [(p.tokens, p.prefix) for p in S.parse('ru* "last" "')] == [(("ru",), True), (("last",), False)]
    assert S.parse("running quickly", stemmed=True)[0].tokens == ("run",)
    for bad in ("", "  ", "x" * 1001):
        with pytest.raises(ValueError):
            S.parse(bad)


def test_an_index_forgets_and_learns(spark):
    docs = lambda *rows: S.documents(spark.createDataFrame(list(rows), "doc_id long, text string"), title=F.lit("t"))
    index = S.TextIndex(spark)
    assert S.search(index, "x").count() == 0
    index.add(docs((1, "alpha beta"), (2, "alpha gamma"), (3, "beta-alpha élan")))
    ids = lambda q: sorted(r["doc_id"] for r in S.search(index, q).collect())
    assert ids("alpha") == [1, 2, 3] and ids("alp") == [1, 2, 3] and ids("beta-alpha") == [3] and ids("a") == [1, 2, 3] and ids("elan") == [3]
    index.remove(spark.createDataFrame([(1,)], "doc_id long"))
    index.replace(docs((2, "delta")))
    assert ids("alpha") == [3] and ids("delta") == [2] and index.corpus_size()[0] == 2
    again = S.TextIndex.opened(spark, index.root)
    assert again.corpus_size() == index.corpus_size() and S.total(again, "alpha").first()["total"] == 1
    index.rebuild(docs((9, "alpha")))
    assert ids("alpha") == [9] and S.TextIndex.opened(spark, index.root).corpus_size()[0] == 1


def test_five_lexical_hits_of_a_question_count(spark):
    chunks = spark.createDataFrame([(0, e, 0, 1 - e / 100) for e in range(40)], "query_id long, entry_id long, chunk_index int, score double")
    hits = spark.createDataFrame([(0, e, float(e)) for e in range(30, 40)], "query_id long, entry_id long, score double")
    got = R.hybrid(chunks, hits, chunks, k=99).collect()
    assert {r["entry_id"] for r in got} == set(range(10)) | set(range(35, 40))


def test_a_tombstone_of_the_same_clock_deletes_nothing(spark):
    from scriptorium.operators import changes as H

    cell = spark.createDataFrame([("t", 1, "x", "a", 100, 0, "p")], "tbl string, row_id long, col string, val string, hlc_ts long, hlc_counter long, site_id string")
    assert H.without_deleted(cell, cell).count() == 1


def test_failed_migrations_leave_those_before_them(spark):
    def broken(spark, tables):
        raise ValueError("no")

    steps = (*M.MIGRATIONS[:2], M.Migration(7, "broken", broken))
    with pytest.raises(M.MigrationError) as e:
        M.migrated(spark, {}, steps)
    assert e.value.version == 7 and M.current_version(e.value.tables) == 2
    done = M.migrated(spark, e.value.tables)
    assert M.current_version(done) == 6 and "entry_chunks" in done


@pytest.mark.parametrize("style", range(len(pdf_writer.STYLES)))
def test_files_of_every_style_read_back(style):
    pages = [["Ünï ligature ﬁ", "日本語 😀", "(paren) \\ back", "two  blanks"], [], ["last"]]
    data = pdf_writer.document(pages, pdf_writer.STYLES[style], "Títle")
    assert pdf.extract_pages(data) == [(1, "Ünï ligature fi\n日本語 😀\n(paren) \\ back\ntwo blanks"), (3, "last")]


def test_lzw_round_trip():
    for size in (0, 1, 500, 5000, 40_000):
        data = bytes((i * i + i // 7) % 251 for i in range(size))
        assert pdf.lzw(pdf_writer.lzw(data)) == data


def test_the_followed_feed_rewrites_only_parts_it_has_changes_for(spark, tmp_path):
    schema = "seq long, tbl string, row_id long, col string, val string, hlc_ts long, hlc_counter long, site_id string, db_version long"
    source = f"{tmp_path}/in"
    for n in range(3):
        rows = [(i, "t", i, "c", f"{n}", n, 0, "s", 1) for i in (range(200) if n == 0 else [7])]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    log = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = SC.follow(log, f"{tmp_path}/state", f"{tmp_path}/check")
    query.awaitTermination()
    got = {r["row_id"]: r["val"] for r in SC.state(spark, f"{tmp_path}/state", query, log.schema).collect()}
    assert len(got) == 200 and got[7] == "2" and got[8] == "0"
    assert spark.read.parquet(f"{tmp_path}/state/batch-2").select("part").distinct().count() == 1
