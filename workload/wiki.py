"""Wiki pages made from documents and conversations, and the jobs over them."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from terrashelf.functions.text import camel_label
from terrashelf.operators import markup
from workload import tables
from workload.tables import read, with_tables


def _text(name: str):
    return F.col(name).cast("string")


def pages(spark, sf_dir):
    """A page per document: a file link, a category, a gallery on every third, then the whole text."""
    i = F.col("doc_id")
    number = (i % 50).cast("string")
    gallery = F.when(i % 3 == 0, F.concat(
        F.lit("<gallery mode=packed>Arquivo:g"), number, F.lit(".png|x\nimagem:h d.png</gallery> Imagem:plain ")
    )).otherwise("")
    call = F.when(i % 4 == 1, "{{ predefinição:Box}}[[Predefinição:Box]]").otherwise("")
    tag = F.when(i % 2 == 0, "miniatura").when(i % 5 == 0, "miniaturadaimagem").otherwise(" Semmoldura")
    text = F.concat(
        F.lit("[[Arquivo: d"), number, F.lit(" x.png |"), tag, F.lit("]] [[Categoria:"), F.col("lang"), F.lit("]] "),
        gallery, call, F.col("text"),
    )
    namespace = F.when(i % 3 == 1, 3014).when(i % 3 == 2, 10).otherwise(0)
    title = F.concat(F.when(i % 3 == 2, F.lit("Predefinição:")).otherwise(""), F.lit("Page_"), (i % 400).cast("string"), F.lit("_of_"), F.col("lang"))
    return read(spark, sf_dir, "documents").select(
        "doc_id", title.alias("page_title"), namespace.alias("page_namespace"), text.alias("text")
    )


_PAGES = """
    SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'Predefinição:' ELSE '' END || 'Page_' || doc_id % 400 || '_of_' || lang
               AS page_title,
           CASE doc_id % 3 WHEN 1 THEN 3014 WHEN 2 THEN 10 ELSE 0 END AS page_namespace,
           '[[Arquivo: d' || doc_id % 50 || ' x.png |' || CASE WHEN doc_id % 2 = 0 THEN 'miniatura'
               WHEN doc_id % 5 = 0 THEN 'miniaturadaimagem' ELSE ' Semmoldura' END || ']] [[Categoria:' || lang || ']] '
           || CASE WHEN doc_id % 3 = 0 THEN '<gallery mode=packed>Arquivo:g' || doc_id % 50 || '.png|x' || chr(10)
               || 'imagem:h d.png</gallery> Imagem:plain ' ELSE '' END
           || CASE WHEN doc_id % 4 = 1 THEN '{{ predefinição:Box}}[[Predefinição:Box]]' ELSE '' END || text AS text
    FROM documents"""


def file_links(spark, sf_dir):
    return markup.file_links(pages(spark, sf_dir), "doc_id", "text")


def file_link_counts(spark, sf_dir):
    return markup.link_counts(file_links(spark, sf_dir))


def canonical_pages(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", F.md5(markup.canonical_page(F.col("text"))).alias("digest"))


def canonical_templates(spark, sf_dir):
    return pages(spark, sf_dir).where("page_namespace = 10").select(
        "doc_id", markup.template_title(F.col("page_title")).alias("title"),
        F.md5(markup.canonical_template(F.col("text"))).alias("digest"),
    )


def markup_rule_counts(spark, sf_dir):
    every = pages(spark, sf_dir)
    templates = [replace(tag, name=f"template: {tag.name}") for tag in markup.TEMPLATE_RULES]
    return markup.rule_counts(every, "text", markup.PAGE_RULES, markup.GALLERY_RULE).unionByName(
        markup.rule_counts(every, "text", templates)
    )


def _manifest(spark, sf_dir):
    """Stored files: those of two thirds of the page numbers, and one unused file per benchmark item."""
    used = read(spark, sf_dir, "documents").where(F.col("doc_id") % 50 % 3 != 0).select(
        F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string"), F.lit("_x.png")).alias("name")
    )
    unused = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("old"), _text("item_id"), F.lit(".png")).alias("name"))
    return used.unionByName(unused).distinct().select(markup.media_path(F.col("name")).alias("path"))


def missing_media(spark, sf_dir):
    return markup.missing_media(file_links(spark, sf_dir), _manifest(spark, sf_dir))


def unused_media(spark, sf_dir):
    return markup.unused_media(file_links(spark, sf_dir), _manifest(spark, sf_dir))


def page_titles(spark, sf_dir):
    return markup.page_titles(pages(spark, sf_dir))


def category_pages(spark, sf_dir):
    return markup.pages_in_category(pages(spark, sf_dir), "doc_id", "text", "de")


def category_counts(spark, sf_dir):
    found = markup.page_categories(pages(spark, sf_dir), "doc_id", "text")
    return found.groupBy("category").agg(F.count(F.lit(1)).alias("n_pages"))


def latest_wiki_texts(spark, sf_dir):
    """Conversations as pages and turns as revisions; the last turn is the latest revision."""
    turns = read(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "text", (F.col("conv_id") * 1000 + F.col("turn")).alias("rev_id")
    )
    page = turns.groupBy("conv_id").agg(F.max("rev_id").alias("page_latest")).select(
        F.concat(F.lit("Talk_"), _text("conv_id")).alias("page_title"),
        F.when(F.col("conv_id") % 4 == 0, 10).otherwise(0).alias("page_namespace"), "page_latest",
    )
    slot = turns.select(F.col("rev_id").alias("slot_revision_id"), (F.col("rev_id") + 1).alias("slot_content_id"))
    content = turns.select(
        (F.col("rev_id") + 1).alias("content_id"), F.concat(F.lit("tt:"), (F.col("rev_id") + 2).cast("string")).alias("content_address")
    )
    text = turns.select((F.col("rev_id") + 2).alias("old_id"), F.col("text").alias("old_text"), F.lit("utf-8").alias("old_flags"))
    return markup.latest_texts(page, turns.select("rev_id"), slot, content, text, 0).select("page_title", "old_text")


def camel_labels(spark, sf_dir):
    """Labels of all levels with their path form; customer names bring other signs and capitals."""
    j = tables.jurisdiction(spark, sf_dir).select("isolabel_ext", "lexlabel")
    names = read(spark, sf_dir, "customer").select(
        F.lit("XX").alias("isolabel_ext"), F.translate("c_name", "#", "-").alias("lexlabel")
    )
    both = j.unionByName(names).withColumn("path_label", camel_label(F.col("lexlabel")))
    return both.withColumn("full_label", F.concat(F.expr("left(isolabel_ext, 2)"), F.lit("-"), "path_label"))


def label_clashes(spark, sf_dir):
    """Part names as dotted labels; different spellings that end in one label."""
    lexlabel = F.when(F.col("p_partkey") % 2 == 0, F.translate("p_name", " ", ".")).otherwise(F.upper(F.translate("p_name", " ", ".")))
    labels = read(spark, sf_dir, "part").select(lexlabel.alias("lexlabel")).distinct()
    return labels.groupBy(camel_label(F.col("lexlabel")).alias("path_label")).agg(
        F.count(F.lit(1)).alias("n_labels")
    ).where("n_labels > 1")


QUERIES = {
    f.__name__: f
    for f in (
        file_links, file_link_counts, canonical_pages, canonical_templates, markup_rule_counts, missing_media, unused_media,
        page_titles, category_pages, category_counts, latest_wiki_texts, camel_labels, label_clashes,
    )
}

# What the jobs must find is told from how a page is made of its document, not by a second set of patterns.
_LINKS = "SELECT DISTINCT doc_id, 'd' || doc_id % 50 || ' x.png' AS file FROM documents"
_SHOWN = "CASE WHEN doc_id % 2 = 0 THEN '{0}' WHEN doc_id % 5 = 0 THEN '{1}' ELSE '{2}' END"


def _made(file: str, shown: str, category: str, gallery: str, call: str) -> str:
    """A page's text with the given spellings."""
    return f"""'[[{file}: d' || doc_id % 50 || ' x.png ' || {shown} || ']] [[{category}:' || lang || ']] '
        || CASE WHEN doc_id % 3 = 0 THEN '<gallery mode=packed>{gallery}:g' || doc_id % 50 || '.png|x' || chr(10)
            || '{gallery if gallery == "File" else "imagem"}:h d.png</gallery> Imagem:plain ' ELSE '' END
        || CASE WHEN doc_id % 4 = 1 THEN '{call}' ELSE '' END || text"""


_CANONICAL = _made(
    "File", _SHOWN.format("|miniatura", "|miniaturadaimagem", "| Semmoldura"), "Category", "File",
    "{{Template:Box}}[[Template:Box]]",
)
_TEMPLATE = _made(
    "File", _SHOWN.format("|thumb", "|thumb", "|frameless"), "Categoria", "Arquivo",
    "{{ predefinição:Box}}[[Predefinição:Box]]",
)
# Rule, hits on a page, and the pages it fires on.
_FIRES = [
    ("template link", 1, "doc_id % 4 = 1"),
    ("template call", 1, "doc_id % 4 = 1"),
    ("category link", 1, "true"),
    ("file link", 1, "true"),
    ("gallery word", 2, "doc_id % 3 = 0"),
    ("template: file link", 1, "true"),
    ("template: frameless", 1, "doc_id % 2 <> 0 AND doc_id % 5 <> 0"),
    ("template: thumb, long form", 1, "doc_id % 2 <> 0 AND doc_id % 5 = 0"),
    ("template: thumb", 1, "doc_id % 2 = 0"),
]
_PATH = "md5({0})[1:1] || '/' || md5({0})[1:2] || '/' || {0}"
_MANIFEST = """
    SELECT """ + _PATH.format("name") + """ AS path FROM (
        SELECT DISTINCT 'd' || doc_id % 50 || '_x.png' AS name FROM documents WHERE doc_id % 50 % 3 <> 0
        UNION SELECT 'old' || item_id || '.png' FROM benchmark)"""
_MEDIA = f"""WITH links AS ({_LINKS}), manifest AS ({_MANIFEST}), wanted AS (
    SELECT DISTINCT file, {_PATH.format("replace(file, ' ', '_')")} AS path FROM links)"""
_CAMEL = """array_to_string(list_transform(regexp_extract_all({0}, '[\\pL\\pN]+|[^\\pL\\pN.]+'),
    lambda r: upper(r[1:1]) || lower(r[2:])), '')"""

ORACLE = {
    "file_links": _LINKS,
    "file_link_counts": f"WITH links AS ({_LINKS}) SELECT file, count(*) AS n_pages FROM links GROUP BY file",
    "canonical_pages": f"SELECT doc_id, md5({_CANONICAL}) AS digest FROM documents",
    "canonical_templates": f"""
        SELECT doc_id, 'Template:Page_' || doc_id % 400 || '_of_' || lang AS title, md5({_TEMPLATE}) AS digest
        FROM documents WHERE doc_id % 3 = 2""",
    "markup_rule_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {hits} * count(*) AS n_hits, count(*) AS n_pages FROM documents WHERE {where}"
        for name, hits, where in _FIRES
    ),
    "missing_media": _MEDIA + " SELECT file, path FROM wanted WHERE path NOT IN (SELECT path FROM manifest)",
    "unused_media": _MEDIA + " SELECT path FROM manifest WHERE path NOT IN (SELECT path FROM wanted)",
    "page_titles": f"""
        WITH pages_ AS ({_PAGES}) SELECT DISTINCT replace(page_title, '_', ' ') AS title FROM pages_
        WHERE page_namespace IN (0, 3014)""",
    "category_pages": "SELECT doc_id FROM documents WHERE lang = 'de'",
    "category_counts": "SELECT lang AS category, count(*) AS n_pages FROM documents GROUP BY lang",
    "latest_wiki_texts": """
        SELECT 'Talk_' || conv_id AS page_title, text AS old_text FROM conversations WHERE conv_id % 4 <> 0
        QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1""",
    "camel_labels": with_tables("jurisdiction", f"""
        SELECT isolabel_ext, lexlabel, {_CAMEL.format("lexlabel")} AS path_label,
               left(isolabel_ext, 2) || '-' || {_CAMEL.format("lexlabel")} AS full_label
        FROM (SELECT isolabel_ext, lexlabel FROM jurisdiction
              UNION ALL SELECT 'XX', replace(c_name, '#', '-') FROM customer)"""),
    "label_clashes": f"""
        SELECT path_label, count(*) AS n_labels FROM (
            SELECT {_CAMEL.format("lexlabel")} AS path_label FROM (
                SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '.')
                                ELSE upper(replace(p_name, ' ', '.')) END AS lexlabel FROM part))
        GROUP BY 1 HAVING count(*) > 1""",
}
