"""Label whole collections of articles sentence by sentence and render them.

Operators: S8 page extraction (title, image, paragraphs) from a pages table,
S7 article lines from text, F2 quote normalisation, W6 runs of equal
prediction inside a paragraph, S11 highlighted HTML per article, M15 the
chain (pages -> sentences -> scores -> spans -> HTML).

Rows are keyed ``(article_id, para_no, sent_no)``; every step is a column
expression, a window over one paragraph, or an aggregate per paragraph /
article, so many articles are labelled in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Prediction -> CSS class of the highlight span, the page
# styles and the HTML entities decoded in extracted text.
SPAN_CLASS = {1: "green-background", 2: "yellow-background", 3: "red-background"}
STYLE = ("    .green-background {\n        background-color: rgb(200, 255, 200);\n    }\n\n"
         "    .red-background {\n        background-color: rgb(255, 200, 200);\n    }\n\n"
         "    .yellow-background {\n        background-color: rgb(255, 255, 150);\n    }")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
DEFAULT_TITLE = "Labeled text"

ARTICLE_RE = r"(?s)<article[^>]*>(.*?)</article>"
H1_RE = r"(?s)<h1[^>]*>(.*?)</h1>"
TITLE_RE = r"(?s)<title[^>]*>(.*?)</title>"
IMG_RE = r"<img[^>]*src=\"([^\"]*)\""
PARA_BREAK_RE = r"(?i)</?p([ \t\n\r\f][^>]*)?>|<br[ \t\n\r\f]*/?>"
TAG_RE = r"<[^>]+>"


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.regexp_replace(c, ent, ch)
    return c


def clean_fragment(c: Column) -> Column:
    """Tags removed, entities decoded, quotes straightened (F2), stripped."""
    return tx.strip_ws(tx.straighten_quotes(decode_entities(F.regexp_replace(c, TAG_RE, ""))))


def extract_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """(page_id, title, image_url, paragraphs array) from raw HTML.

    Title: the article's ``<h1>``, else ``<title>``; image: the first
    ``<img src>``; paragraphs: the article body split at ``<p>``/``</p>``/
    ``<br>``, tags stripped, entities decoded, empty pieces dropped. A page
    without ``<article>`` gives its main text (see ``page_blocks``)."""
    body = F.regexp_extract(F.col(html), ARTICLE_RE, 1)
    h1 = F.nullif(clean_fragment(F.regexp_extract(body, H1_RE, 1)), F.lit(""))
    title = F.coalesce(h1, F.nullif(clean_fragment(F.regexp_extract(F.col(html), TITLE_RE, 1)), F.lit("")))
    image = F.nullif(F.regexp_extract(F.col(html), IMG_RE, 1), F.lit(""))
    rest = F.regexp_replace(body, H1_RE, "")
    paras = F.filter(F.transform(F.split(rest, PARA_BREAK_RE), clean_fragment), lambda p: p != F.lit(""))
    return pages.select(F.col(id_col).alias("article_id"), title.alias("title"),
                        image.alias("image_url"),
                        F.when(F.col(html).rlike(ARTICLE_RE), paras).otherwise(main_text(F.col(html))).alias("paragraphs"))


# Elements whose text is never read, and elements that end a block.
SKIP_RE = (r"(?is)<!--.*?-->|<(script|style|noscript|template|head|svg|select|textarea)([ \t\n\r\f][^>]*)?>.*?"
           r"</(script|style|noscript|template|head|svg|select|textarea)[ \t\n\r\f]*>")
BLOCK_RE = (r"(?i)</?(address|article|aside|blockquote|body|br|caption|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|"
            r"header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)([ \t\n\r\f][^>]*)?/?>")
LINK_RE = r"(?is)<a([ \t\n\r\f][^>]*)?>"
# marks put in place of tags; texts that hold them already lose them
BLOCK_MARK, LINK_ON, LINK_OFF = "\u0003", "\u0001", "\u0002"
MAX_LINK_SHARE = 0.33  # more of a block's characters in links: navigation
MANY_WORDS, SOME_WORDS = 15, 4  # a block of text; a short one that stands beside such a block


def page_blocks(html: Column) -> Column:
    """The page's blocks in order, as ``(text, n_words, link_share, kept)``: the tag stream without
    scripts, styles and comments, cut where an element begins or ends a block.

    A block is kept if few of its characters stand in links and it has ``MANY_WORDS`` words, or
    ``SOME_WORDS`` beside a block that is kept for its words: the density rules of boilerplate detection."""
    plain = F.regexp_replace(F.coalesce(html, F.lit("")), "[\u0001-\u0003]", "")
    marked = F.regexp_replace(F.regexp_replace(plain, SKIP_RE, " "), BLOCK_RE, BLOCK_MARK)
    marked = F.regexp_replace(F.regexp_replace(marked, LINK_RE, LINK_ON), r"(?i)</a[ \t\n\r\f]*>", LINK_OFF)
    pieces = F.split(F.regexp_replace(marked, TAG_RE, ""), BLOCK_MARK)

    def solid(x: Column) -> Column:
        return F.length(F.regexp_replace(x, r"[ \t\n\r\f\x0B\u0001\u0002]+", ""))

    def block(x: Column) -> Column:
        text = tx.strip_ws(tx.straighten_quotes(decode_entities(F.regexp_replace(x, "[\u0001\u0002]", ""))))
        linked = solid(x) - solid(F.regexp_replace(x, "\u0001[^\u0002]*(\u0002|$)", ""))
        return F.struct(text.alias("text"), F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))).alias("n_words"),
                        F.when(solid(x) > 0, linked / solid(x)).otherwise(0.0).alias("link_share"))

    blocks = F.filter(F.transform(pieces, block), lambda b: b["text"] != "")

    def full(b: Column) -> Column:
        return F.coalesce((b["n_words"] >= MANY_WORDS) & (b["link_share"] <= MAX_LINK_SHARE), F.lit(False))

    def judge(every: Column) -> Column:
        return F.transform(every, lambda b, i: F.struct(
            b["text"].alias("text"), b["n_words"].alias("n_words"), b["link_share"].alias("link_share"),
            (full(b) | ((b["n_words"] >= SOME_WORDS) & (b["link_share"] <= MAX_LINK_SHARE)
                        & (full(F.get(every, i - 1)) | full(F.get(every, i + 1))))).alias("kept")))

    return F.transform(F.array(blocks), judge)[0]


def main_text(html: Column) -> Column:
    """S8 where a page names no article: the kept blocks as paragraphs."""
    return F.transform(F.filter(page_blocks(html), lambda b: b["kept"]), lambda b: b["text"])


def text_articles(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A text article, one paragraph per line (line order kept)."""
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: tx.strip_ws(tx.straighten_quotes(x))),
                     lambda x: x != F.lit(""))
    return df.select(F.col(id_col).alias("article_id"), F.lit(None).cast("string").alias("title"),
                     F.lit(None).cast("string").alias("image_url"), lines.alias("paragraphs"))


def article_sentences(articles: DataFrame) -> DataFrame:
    """Articles -> rows (article_id, para_no, sent_no, text) by F1."""
    paras = articles.select("article_id", F.posexplode("paragraphs").alias("para_no", "para"))
    return paras.select("article_id", "para_no",
                        F.posexplode(tx.split_sentences("para")).alias("sent_no", "text"))


def runs(scored: DataFrame, pred: str = "pred") -> DataFrame:
    """Merge consecutive sentences of equal prediction inside a
    paragraph into one span: (article_id, para_no, run_no, pred, text).
    The window spans one paragraph."""
    w = Window.partitionBy("article_id", "para_no").orderBy("sent_no")
    flagged = scored.withColumn(
        "_chg", F.when(F.lag(pred).over(w) == F.col(pred), 0).otherwise(1))
    numbered = flagged.withColumn("run_no", F.sum("_chg").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return (numbered.groupBy("article_id", "para_no", "run_no")
            .agg(F.first(pred).alias(pred),
                 F.array_sort(F.collect_list(F.struct("sent_no", "text"))).alias("_s"))
            .select("article_id", "para_no", "run_no", pred,
                    F.array_join(F.transform("_s", lambda s: s["text"]), " ").alias("text")))


def span_html(pred: Column, text: Column) -> Column:
    cls = F.create_map(*[x for k, v in SPAN_CLASS.items() for x in (F.lit(k), F.lit(v))])[pred]
    return F.when(cls.isNull(), text).otherwise(
        F.concat(F.lit('<span class="'), cls, F.lit('">'), text, F.lit("</span>")))


def render(articles: DataFrame, spans: DataFrame) -> DataFrame:
    """One HTML document per article (article_id, html). A paragraph is
    its spans each followed by one space; paragraphs keep their order."""
    paras = (spans.withColumn("_h", F.concat(span_html(F.col("pred"), F.col("text")), F.lit(" ")))
             .groupBy("article_id", "para_no")
             .agg(F.array_sort(F.collect_list(F.struct("run_no", "_h"))).alias("_r"))
             .select("article_id", "para_no",
                     F.concat(F.lit("<p>\n"), F.array_join(F.transform("_r", lambda r: r["_h"]), ""),
                              F.lit("\n</p>\n")).alias("_p")))
    body = (paras.groupBy("article_id")
            .agg(F.array_sort(F.collect_list(F.struct("para_no", "_p"))).alias("_ps"))
            .select("article_id", F.array_join(F.transform("_ps", lambda p: p["_p"]), "").alias("_body")))
    a = articles.select("article_id", "title", "image_url")
    head = F.concat(F.lit("<head>\n<title>"), F.coalesce(F.col("title"), F.lit(DEFAULT_TITLE)),
                    F.lit("</title>\n<style>\n" + STYLE + "\n</style>\n"
                          '<meta content="text/html;charset=utf-8" http-equiv="Content-Type">\n'
                          '<meta content="utf-8" http-equiv="encoding">\n</head>\n'))
    top = F.concat(F.lit("<body>"),
                   F.coalesce(F.concat(F.lit("\n<h1>"), F.col("title"), F.lit("</h1>")), F.lit("")),
                   F.coalesce(F.concat(F.lit('\n<img src="'), F.col("image_url"), F.lit('">')), F.lit("")))
    return (a.join(body, "article_id", "left")
            .select("article_id", F.concat(F.lit("<!DOCTYPE html>\n<html>\n"), head, F.lit("\n"), top,
                                           F.coalesce(F.col("_body"), F.lit("")),
                                           F.lit("</body>\n</html>\n")).alias("html")))


def rule_pred(text: Column, n_classes: int = 4) -> Column:
    """SQL-expressible stand-in for a model: ``length(text) % n_classes``."""
    return (F.length(text) % n_classes).cast("int")


def write_html(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S11 sink: Parquet shards of ``(article_id, html)``, about one file per
    task, with min/max statistics on the id for lookups of single articles."""
    docs.select("article_id", "html").sortWithinPartitions("article_id").write.mode(mode).parquet(path)
