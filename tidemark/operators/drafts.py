"""Summary requests, settled summaries, draft and article records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SUMMARY_HEAD, UNTITLED, col, fallback_summary, sanitize_summary, strip
from ..functions.urls import canonical_url
from .hits import with_default

# Fixed values.
GUIDE = "你是中文公众号编辑。只基于原文写摘要，不要扩写，不要编造，不要增加原文不存在的数据。\n长度不超过 {{MAX_CHARS}} 字。"
EDITOR = "你是严谨的中文编辑。"
SHORT_NOTICE = "原文正文不足，暂不生成摘要。"
CITATION = "<p><br/></p><p><strong>引用说明</strong>：本文为基于公开网页内容的摘要整理，仅供信息参考，不构成任何投资或决策建议。</p>"
MARKETING = ("惊喜", "重磅", "里程碑", "引领", "突破性", "赋能")
DASHES = ("—", "--")  # a doubled long dash holds a single one
MAX_CHARS = 2_200
SOURCE_CHARS = 12_000


def source_text(text: Column | str) -> Column:
    return F.substring(strip(F.coalesce(col(text), F.lit(""))), 1, SOURCE_CHARS)


def summary_request(title: Column | str, text: Column | str, n: int = MAX_CHARS, guide: str = GUIDE, model: str = "chat") -> Column:
    """Struct ``(notice, request)``: a fixed notice for an empty text, else the chat request as JSON."""
    body = source_text(text)
    t = F.coalesce(col(title), F.lit(""))
    prompt = F.concat(strip(F.lit(guide.replace("{{MAX_CHARS}}", str(n)))), F.lit("\n\n标题："), t, F.lit("\n\n原文：\n"), body, F.lit("\n\n仅输出摘要正文。"))
    messages = F.array(F.struct(F.lit("system").alias("role"), F.lit(EDITOR).alias("content")), F.struct(F.lit("user").alias("role"), prompt.alias("content")))
    request = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0.7).alias("temperature"), F.lit(min(4096, n + 800)).alias("max_tokens"), messages.alias("messages")))
    notice = F.concat(F.lit(SUMMARY_HEAD), t, F.lit("\n" + SHORT_NOTICE))
    return F.struct(F.when(body == "", notice).alias("notice"), F.when(body != "", request).alias("request"))


def resolve_summary(answer: Column | str, title: Column | str, text: Column | str, n: int = MAX_CHARS) -> Column:
    """The cleaned answer, at most ``n`` characters; without one the fallback, or the notice for an empty text."""
    a = strip(F.coalesce(col(answer), F.lit("")))
    body = source_text(text)
    notice = F.concat(F.lit(SUMMARY_HEAD), F.coalesce(col(title), F.lit("")), F.lit("\n" + SHORT_NOTICE))
    return F.when(body == "", notice).when(a != "", F.substring(sanitize_summary(a), 1, n)).otherwise(fallback_summary(title, body, n))


def draft_record(title: Column | str, summary: Column | str, url: Column | str, cover: Column | str, author: str) -> Column:
    """A draft as a struct: fields cut to their lengths, summary escaped, line ends as ``<br/>``, citation added."""
    s = F.coalesce(col(summary), F.lit(""))
    safe = strip(s)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "<br/>")):
        safe = F.replace(safe, F.lit(a), F.lit(b))
    t = F.coalesce(col(title), F.lit(""))
    article = F.struct(
        F.substring(F.when(t == "", UNTITLED).otherwise(t), 1, 64).alias("title"),
        F.lit(author[:16]).alias("author"),
        F.substring(s, 1, 120).alias("digest"),
        F.concat(F.lit("<p>"), safe, F.lit("</p>" + CITATION)).alias("content"),
        F.substring(F.coalesce(col(url), F.lit("")), 1, 500).alias("content_source_url"),
        col(cover).alias("thumb_media_id"),
        F.lit(1).alias("show_cover_pic"),
    )
    return F.struct(F.array(article).alias("articles"))


def summary_audit(summary: Column | str, text: Column | str, n: int = MAX_CHARS, words: tuple[str, ...] = MARKETING, dashes: tuple[str, ...] = DASHES) -> Column:
    """Struct of checks that the style guide allows a machine: length, dashes, marketing words, bold marks, links, numbers not in the source."""
    s, t = F.coalesce(col(summary), F.lit("")), F.coalesce(col(text), F.lit(""))
    bold = lambda x: F.regexp_count(x, F.lit(r"\*\*[^*]+\*\*"))
    numbers = lambda x: F.array_distinct(F.regexp_extract_all(x, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)))
    return F.struct(
        (F.length(s) > n).alias("too_long"),
        F.exists(F.array(*[F.lit(d) for d in dashes]), lambda d: F.contains(s, d)).alias("dashes"),
        F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(s, w)).alias("marketing"),
        ((bold(s) > 8) | F.exists(F.split(s, "\n"), lambda p: bold(p) > 2)).alias("too_bold"),
        s.rlike(r"(?i)https?://|\]\(").alias("link"),
        F.array_sort(F.array_except(numbers(s), numbers(t))).alias("new_numbers"),
    )


def article_record(df: DataFrame, as_of: Column, batch_id: int = 0) -> DataFrame:
    """Settled rows ``(title, url, published_at, text, summary)`` as history records; the id is a hash of the canonical URL, so reruns repeat."""
    return df.select(
        F.sha2(canonical_url("url"), 256).alias("id"),
        "title",
        F.col("url").alias("source_url"),
        F.col("published_at").alias("source_published_at"),
        F.col("text").alias("extracted_text"),
        "summary",
        F.lit("published").alias("status"),
        as_of.alias("created_at"),
        as_of.alias("published_at"),
        F.lit(batch_id).cast("long").alias("batch_id"),
    )


def settle_drafts(df: DataFrame, answers: DataFrame, covers: DataFrame, default_cover: str, author: str, n: int = MAX_CHARS) -> DataFrame:
    """Rows ``(id, title, url, text, cover_url)`` with request, summary, media_id and draft.

    ``answers`` is ``(id, content)``, ``covers`` ``(image_url, media_id, rejected)``.
    """
    asked = df.withColumn("request", summary_request("title", "text", n)["request"])
    told = with_default(asked, answers, "id", "id", "content", F.lit(None).cast("string"))
    told = told.withColumn("summary", resolve_summary("content", "title", "text", n)).drop("content")
    shown = with_default(told, covers, "cover_url", "image_url", "media_id", F.lit(default_cover), "rejected")
    return shown.withColumn("draft", draft_record("title", "summary", "url", "media_id", author))
