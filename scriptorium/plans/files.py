"""PDF files: pages, titles, import and reading anew."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import listing as L
from ..operators import saving as S
from ..session import spread
from ..sources import archive as A
from ..sources import pdf
from ..sources import pdf_writer as W
from .registry import Catalogue
from .saving import FIRST, empty

C = Catalogue()

#: The pages of the documents' files: lines without blanks at their ends, words cut at a line's end made whole.
PAGES = rf"""l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
c AS (SELECT doc_id, i, CAST(i // {W.PAGE_LINES} + 1 AS INTEGER) AS page_num, regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '^[\s\p{{Z}}\x{{85}}]+|[\s\p{{Z}}\x{{85}}]+$', '', 'g') AS line FROM l),
p AS (SELECT doc_id, page_num, regexp_replace(string_agg(line, chr(10) ORDER BY i), '(\p{{L}})(?:-\n|\n-\n)(\p{{Ll}})', '\1\2', 'g') AS text FROM c WHERE line <> '' GROUP BY doc_id, page_num)"""


def documents(spark, sf):
    return W.files(A.read(spark, sf, "documents"))


@C.query("pdf_pages", f"WITH {PAGES} SELECT doc_id, page_num, text FROM p")
def pdf_pages(spark, sf):
    """Every document as a PDF file, in ten styles, read back."""
    found = pdf.pages(documents(spark, sf))
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long").alias("doc_id"), "page_num", "text")


@C.query("pdf_whole_texts", f"WITH {PAGES} SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text, count(*) AS page_count FROM p GROUP BY doc_id")
def pdf_whole_texts(spark, sf):
    found = pdf.whole_texts(pdf.pages(documents(spark, sf)))
    return found.select(F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long").alias("doc_id"), "text", "page_count")


LONG = " ".join(["filler"] * 60)


def _titled(n: int) -> bytes:
    """By turns: a title in large letters, a publisher's line instead, none at all, one in a form and too generic a one."""
    style = W.STYLES[n % len(W.STYLES)]
    heads = {0: {0: f"Report {n} on things"}, 1: {0: f"Downloaded from shelf {n}"}, 2: {}, 3: {0: f"Study {n}, part one"}, 4: {0: "PDF"}}[n % 5]
    return W.document([[LONG, LONG], ["second page"]], style, "" if n % 15 == 2 else f"Titel ä {n}", heads)


@C.query(
    "pdf_titles",
    """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Report ' || c_custkey || ' on things' WHEN 3 THEN 'Study ' || c_custkey || ', part one'
ELSE CASE WHEN c_custkey % 15 = 2 THEN NULL ELSE 'Titel ä ' || c_custkey END END AS title FROM customer""",
)
def pdf_titles(spark, sf):
    @F.pandas_udf("binary")
    def made(keys):
        return keys.map(lambda n: _titled(int(n)))

    keys = spread(A.read(spark, sf, "customer").select("c_custkey"))  # few bytes a row, so few partitions, but a file each
    files = keys.select(F.col("c_custkey").cast("string").alias("path"), made(F.col("c_custkey")).alias("content"))
    return pdf.titles(files).select(F.col("path").cast("long").alias("c_custkey"), "title")


@C.query(
    "pdf_import",
    f"""WITH {PAGES}, t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text, count(*) AS page_count FROM p GROUP BY doc_id)
SELECT CAST(doc_id AS VARCHAR) AS title, coalesce(page_count, 0) AS page_count, strlen(coalesce(t.text, '')) AS bytes, CASE WHEN t.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS index_status
FROM documents LEFT JOIN t USING (doc_id) WHERE doc_id % 4 = 0""",
)
def pdf_import(spark, sf):
    """Files read into entries, pages and texts; a title is the file's stem."""
    d = A.read(spark, sf, "documents").where("doc_id % 4 = 0")
    requests = L.pdf_requests(W.files(d))
    a = S.saved(empty(spark), requests, FIRST)
    rows = a["entries"].join(a["entry_content"].withColumnRenamed("entry_id", "id"), "id")
    return rows.select("title", "page_count", F.octet_length("extracted_text").cast("long").alias("bytes"), "index_status")


@C.query(
    "pdf_reprocess",
    f"""WITH {PAGES}, t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_num) AS text, count(*) AS page_count FROM p GROUP BY doc_id)
SELECT doc_id AS id, coalesce(page_count, 0) AS page_count, strlen(coalesce(t.text, '')) AS bytes, CASE WHEN t.doc_id IS NULL THEN 'failed' ELSE 'ok' END AS index_status, 2 AS index_version
FROM documents LEFT JOIN t USING (doc_id) WHERE doc_id % 5 = 0 AND doc_id % 3 <> 0""",
)
def pdf_reprocess(spark, sf):
    """Files whose text was made by an older version are read anew; those of the present one, and articles, are not."""
    d = A.read(spark, sf, "documents")
    own = W.files(d.where("doc_id % 5 = 0")).select(F.regexp_extract("path", r"(\d+)\.pdf", 1).cast("long").alias("id"), F.col("content").alias("pdf_data"))
    files = own.unionByName(d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("id"), F.lit(None).cast("binary").alias("pdf_data")))  # articles have no file
    version = F.when(F.col("id") % 3 == 0, 2).otherwise(1)
    kind = F.when(F.col("id") % 5 == 0, "pdf").otherwise("article")
    rows = files.select("id", kind.alias("content_type"), "pdf_data", F.lit("old").alias("extracted_text"), F.lit("ok").alias("index_status"), version.alias("index_version"))
    out = L.reprocessed(L.to_reprocess(rows, 2), 2)
    return out.select("id", "page_count", F.octet_length("extracted_text").cast("long").alias("bytes"), "index_status", "index_version")


@C.query("file_names", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Paper ' || page_id WHEN page_id % 3 = 1 THEN 'scan' || page_id ELSE 'Untitled PDF' END AS title FROM pages")
def file_names(spark, sf):
    """A title that is given, else the file's stem, else the fallback."""
    n = F.col("page_id")
    path = F.when(n % 3 == 2, "dir/").otherwise(F.concat(F.lit("/dir/scan"), n, F.lit(".pdf")))
    given = F.when(n % 3 == 0, F.concat(F.lit("Paper "), n))
    return A.read(spark, sf, "pages").select("page_id", X.file_title(path, given).alias("title"))
