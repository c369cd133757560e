"""Rows and labels of entries: validation, titles by a model, snapshots, terminal output, peers, names of archives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import pdf
from ..sources.archive import CONTENT_TYPES, INDEX_STATUSES
from .retrieval import TEMPLATES

TITLE_CHARS, TITLE_LEAST, TITLE_MOST = 3000, 5, 200
# Fixed value: the system message of title prompts.
TITLE_SYSTEM = (
    "You extract or generate document titles. Rules:\n"
    "- If the document has a clear title (heading, paper title, datasheet name), use it exactly\n"
    "- Only generate a summary title if the document has no clear title\n"
    "- Preserve part numbers (MP6002, AD9446, LT1533), application note numbers (AN133), and model numbers\n"
    "- Output ONLY the title, nothing else. No quotes, no explanation\n"
    "- Maximum 15 words"
)


@dataclass(frozen=True)
class Model:
    id: str
    size_bytes: int
    sha256: str
    context: int
    least_ram_mb: int
    template: str


# The local models that can be chosen, with the digests of their files.
MODELS = (
    Model("smollm2-360m-q8", 386_404_992, "48ab3034d0dd401fbc721eb1df3217902fee7dab9078992d66431f09b7750201", 2048, 512, "chatml"),
    Model("qwen2.5-1.5b-q4km", 1_117_320_736, "6a1a2eb6d15622bf3c96857206351ba97e1af16c30d7a74ee38970e434e9407e", 32768, 1200, "chatml"),
    Model("smollm3-3b-q4km", 1_915_305_312, "8334b850b7bd46238c16b0c550df2138f0889bf433809008cc17a8b05761863e", 8192, 2200, "chatml"),
    Model("llama3.2-3b-q4km", 2_019_377_696, "6c1a2b41161032677be168d354123594c0e6e67d2b9227c84f296ad037c728ff", 131072, 2400, "llama3"),
    Model("phi4-mini-q4km", 2_491_874_272, "88c00229914083cd112853aab84ed51b87bdf6b9ce42f532d8c85c7c63b1730a", 131072, 2800, "chatml"),
    Model("gemma3-4b-q4km", 2_489_758_112, "4996030242583a40aa151ff93f49ed787ac8c25e4120c3ae4588b2e2a7d1ae94", 131072, 2800, "gemma"),
)


def model(name: str) -> Model | None:
    return next((m for m in MODELS if m.id == name), None)


def template_of(name: str | None) -> str:
    """The chat template of a model; of an unknown one, or none, the first."""
    found = model(name) if name else None
    return found.template if found else "chatml"


def digest_matches(content: Column, digest: Column | str) -> Column:
    """Whether a file's SHA-256 is the given one, in either case."""
    return F.sha2(content, 256) == F.lower(F.lit(digest) if isinstance(digest, str) else digest)


def title_prompt(text: Column, template: str = "chatml") -> Column:
    """The prompt for a title of the text's first 3000 characters; null for texts below 50 bytes."""
    opening, closing, before, between, after, last = TEMPLATES[template]
    turn = "" if template == "gemma" else f"{before}user{between}"
    asked = F.concat(F.lit(f"{opening}{TITLE_SYSTEM}{closing}{turn}What is the title of this document?\n\n"), F.left(text, F.lit(TITLE_CHARS)), F.lit(after + last))
    return F.when(F.octet_length(text) >= 50, asked)


def model_title(raw: Column) -> Column:
    """A model's answer as a title: its first line without quotes and bold signs, cleaned; null if too short or too long."""
    inner = lambda t, n: F.substring(t, n + 1, F.char_length(t) - 2 * n)
    quoted = lambda t: (F.char_length(t) >= 2) & ((t.startswith('"') & t.endswith('"')) | (t.startswith("'") & t.endswith("'")))
    bold = lambda t: (F.char_length(t) >= 4) & t.startswith("**") & t.endswith("**")
    # Every step has the last one's result as a variable: the answer is made once.
    plain = X.let(F.substring_index(X.trim(raw), "\n", 1), lambda t: F.when(quoted(t), inner(t, 1)).otherwise(t))
    plain = X.let(plain, lambda t: F.when(bold(t), inner(t, 2)).otherwise(t))
    return X.let(X.clean_title(plain), lambda t: F.when(F.octet_length(t).between(TITLE_LEAST, TITLE_MOST), t))


def to_retitle(entries: DataFrame, prefixes: list[str] = (), only_generic: bool = False, created: str = "created_s") -> DataFrame:
    """Entries that a model is to name, newest first: those whose id begins with one of the prefixes, if there are any."""
    hit = F.lit(True)
    if prefixes:
        hit = F.lit(False)
        for p in prefixes:
            hit = hit | F.col("id").cast("string").startswith(p)
    if only_generic:
        hit = hit & X.is_generic_title("title")
    return entries.where(hit).orderBy(F.desc(created), "id")


def retitled(rows: DataFrame) -> DataFrame:
    """``id, title`` of the rows ``id, title, content_type, extracted_text, readable_html, pdf_data`` whose title changes:
    from the headings of an article or the large letters of a PDF file, else from the text, cleaned."""
    files = rows.where((F.col("content_type") != "article") & F.col("pdf_data").isNotNull())
    named = pdf.titles(files.select(F.col("id").cast("string").alias("path"), F.col("pdf_data").alias("content"))).withColumnRenamed("title", "_own")
    held = rows.withColumn("path", F.col("id").cast("string")).join(named, "path", "left")
    heading = X.html_title(F.decode("readable_html", "UTF-8"))
    found = F.when(F.col("content_type") == "article", heading).otherwise(F.col("_own"))
    new = X.clean_title(F.coalesce(found, X.text_title("extracted_text")))
    return held.select("id", new.alias("new"), "title").where("new is not null and new <> title").select("id", F.col("new").alias("title"))


def valid(rows: DataFrame) -> DataFrame:
    """Rows whose id is a UUID and whose times are in RFC 3339, with unknown kinds and states at their defaults."""
    uuid = "^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"
    kept = rows.where(F.col("id").rlike(uuid)).withColumns({c: F.try_to_timestamp(c) for c in ("created_at", "updated_at")})
    known = lambda c, names, other: F.when(F.col(c).isin(*names), F.col(c)).otherwise(other)
    return kept.where("created_at is not null and updated_at is not null").withColumns(
        {"content_type": known("content_type", CONTENT_TYPES, "article"), "index_status": known("index_status", INDEX_STATUSES, "ok")}
    )


def shown_tags(counts: DataFrame, least: int = 2) -> DataFrame:
    return counts.where(F.col("count") >= least)


def shown_title(title: Column) -> Column:
    """Whether a title is neither too short nor too long to be offered."""
    return (F.char_length(title) > 10) & (F.char_length(title) < 80)


def highlighted(snippet: Column) -> Column:
    """Marks as the terminal's bold yellow."""
    return F.replace(F.replace(snippet, F.lit("<mark>"), F.lit("\x1b[1;33m")), F.lit("</mark>"), F.lit("\x1b[0m"))


def is_pdf_page(url: Column, mime: Column | None = None, html: Column | None = None) -> Column:
    """Whether a page is a PDF file: by its path, its content type or an embedded viewer."""
    out = F.coalesce(F.lower(F.try_parse_url(url, F.lit("PATH"))).endswith(".pdf"), F.lit(False))
    if mime is not None:
        out = out | F.coalesce(F.lower(mime).startswith("application/pdf"), F.lit(False))
    if html is not None:
        out = out | F.coalesce(html.rlike(r'(?i)<embed\b[^>]*type="application/pdf"'), F.lit(False))
    return out


def without_repeated_styles(html: Column) -> Column:
    """The page with each ``<style>`` block once, where it is first."""
    block = r"(?is)<style\b[^>]*>.*?</style>"
    pieces = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(rf"\G((?s:.*?))(?:({block})|\z)"), F.lit(1)).alias("gap"), F.regexp_extract_all(html, F.lit(rf"\G((?s:.*?))(?:({block})|\z)"), F.lit(2)).alias("style")
    )

    def step(acc: Column, x: Column) -> Column:
        known = F.array_contains(acc["seen"], x["style"])
        return F.struct(F.concat(acc["out"], F.array(x["gap"], F.when(known, "").otherwise(x["style"]))).alias("out"), F.array_union(acc["seen"], F.array(x["style"])).alias("seen"))

    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("out"), empty.alias("seen"))
    return F.when(html.rlike(block), F.array_join(F.aggregate(pieces, zero, step, lambda acc: acc["out"]), "")).otherwise(html)


def exported(entries: DataFrame, content: DataFrame | None, at: Column) -> DataFrame:
    """One row ``value``: the export's envelope of version, time and number; entries are written beside it, a line each."""
    total = entries.agg(F.count(F.lit(1)).alias("total"))
    return total.select(F.to_json(F.struct(F.lit(1).alias("version"), at.alias("exported_at"), "total", F.lit(content is not None).alias("with_content"))).alias("value"))


def peers(rows: DataFrame) -> DataFrame:
    return rows.orderBy("name", "id")


def archive_path(name: str, home: str) -> str:
    """A path if it looks like one, else the archive of that name in the home folder."""
    return name if "/" in name or name.endswith(".db") else f"{home}/{name}"


def rows_exist(rows: DataFrame, keys: DataFrame, key: Column) -> DataFrame:
    """``keys(row_id)`` with ``exists``: whether ``rows`` has a row whose ``key`` is that."""
    held = rows.select(key.alias("row_id")).distinct().withColumn("exists", F.lit(True))
    return keys.join(held, "row_id", "left").withColumn("exists", F.coalesce("exists", F.lit(False)))
