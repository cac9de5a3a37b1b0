"""Problem 8: template residue, filler, error pages and script notices in place of content, by evidence.

A page that stands in place of content fits neither its address nor its title, names nothing that other
pages speak of, and uses words that pages with content don't use; often its body stands at many addresses.
All of this is counted over the corpus; no phrase of an error page or notice is listed anywhere. Only
unfilled fields are told by their syntax.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainlake.storage import Scratch

_NAME = r"[A-Za-z](?:[\w.]|[ -](?=\w)){0,40}"
_HTML = "a abbr b blockquote body br center code div em footer font form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input label li link main meta nav noscript ol option p pre q s script section small span strike strong style sub sup svg table tbody td th thead title tr tt u ul var video"

#: Fields of common template languages and mail-merge forms, and instructions to the author, outside of code.
_FIELDS = (
    rf"\{{\{{[-#/^&!>]?\s*{_NAME}\s*-?\}}\}}",
    rf"\{{%-?\s*{_NAME}\s*-?%\}}",
    rf"<%[=-]?\s*{_NAME}\s*-?%>",
    rf"[$#]\{{\s*{_NAME}\s*\}}",
    rf"(?<![\w$#{{\\])\{{{_NAME}\}}(?!\}})",
    r"%\([A-Za-z_]\w*\)[sdifr]",
    rf"\[\[\s*{_NAME}\s*\]\](?!\()",
    rf"<<\s*{_NAME}\s*>>",
    rf"@@\s*{_NAME}\s*@@",
    r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*__(?!\w)",
    r"(?<![\w$])\$[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*\$(?!\w)",
    r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*%(?!\w)",
    r"«\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+){0,3}»(?!\s*\()",
    rf"&lt;\s*{_NAME}\s*&gt;",
    rf"<(?!/?(?i:{_HTML.replace(' ', '|')})\b){_NAME}>(?!_|\w)",
    r"\[[A-Z][A-Z0-9]*(?:[ _-][A-Z0-9]+)*\](?![(\w])",
    r"[\[<(](?i:insert|enter|add|fill in|type|choose|select|your) [^\]>)\n]{1,60}[\]>)]",
    r"\((?i:[\w -]{1,50} goes here)\)",
    r"\bYOUR(?: [A-Z0-9]+){1,5} HERE\b",
    r"\b(?:REPLACE|CHANGE|FILL|INSERT|EDIT)_(?:ME|THIS|IN|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)\b",
)
_FIELD = "(?U)" + "|".join(_FIELDS)
#: What every text with a field holds; few others do, and only those pay for the patterns above.
_SIGNS = ("{", "<", "[", "%", "$", "«", "@@", "__", "&lt;", " HERE", "REPLACE_", "CHANGE_", "FILL_", "INSERT_", "EDIT_")
_BRACKET = r"(?i)\((?:insert|enter|add|fill in|type|choose|select|your|[^()]{1,60} goes here)"
_CODE = r"(?s)```.*?(?:```|\z)|``[^\n]*?``|`[^`\n]*`|(?i:<(code|pre)\b.*?</\1>)"

#: Coded names (of proteins, systems, runs): a token with letters and digits. Words: tokens of letters only.
_CODED = r"(?<![a-z0-9])(?=[a-z]*[0-9])(?=[0-9]*[a-z])[a-z0-9]{5,}"
_PLAIN = r"(?<![\p{L}\p{N}])\p{L}++(?!\p{N})"
_STOPS = (".", "!", "?", "…")


def open_field(text: Column) -> Column:
    """Whether a template field was left unfilled, outside of code spans."""
    signs = text.contains("(") & text.rlike(_BRACKET)
    for sign in _SIGNS:
        signs = text.contains(sign) | signs
    return F.when(signs, F.regexp_replace(text, _CODE, " ").rlike(_FIELD)).otherwise(F.lit(False))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\r\f "))), lambda x: x != "")


def _title_lines(lines: Column) -> Column:
    """How many of the first lines are the title: those up to the first that holds a coded name, if none of them ends like a sentence and something follows."""
    ends = lambda x: F.right(x, F.lit(1)).isin(*_STOPS)
    first = F.array_position(F.transform(lines, lambda x: ends(x) | x.rlike("[a-z][0-9]|[0-9][a-z]")), True)
    heads = (first > 0) & (first < F.size(lines)) & ~ends(F.element_at(lines, F.when(first > 0, first.cast("int")).otherwise(F.lit(1))))
    return F.when(F.size(lines) == 0, 0).when(heads, first.cast("int")).otherwise(0)


def page_terms(documents: DataFrame) -> DataFrame:
    """One row per document with a text: address, open field, coded names of title and body, and the body's words, all in lower case."""
    rows = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND trim(text) <> ''")
    rows = rows.select(
        "doc_id", F.lower("source").alias("site"), F.concat_ws(" ", F.lower("source"), F.lower("system_id")).alias("host"), F.xxhash64("text").alias("text_hash"), open_field(F.col("text")).alias("field"), _lines(F.lower("text")).alias("lines")
    )
    rows = rows.withColumn("k", _title_lines(F.col("lines")))
    body = F.array_join(F.slice("lines", F.col("k") + 1, F.greatest(F.size("lines") - F.col("k"), F.lit(0))), "\n")
    rows = rows.select("doc_id", "site", "host", "text_hash", "field", F.array_join(F.slice("lines", F.lit(1), F.col("k")), "\n").alias("title"), body.alias("body"))
    title = F.array_union(_all(F.col("title"), _CODED), F.filter(_all(F.col("host"), "[a-z0-9]{4,}"), lambda x: x.rlike("[0-9]")))
    return rows.select("doc_id", "site", "host", "text_hash", "field", title.alias("title_codes"), F.array_distinct(_all(F.col("body"), _CODED)).alias("codes"), _all(F.col("body"), _PLAIN).alias("words"))


def _naming(pages: DataFrame) -> DataFrame:
    """doc_id of the pages whose body names something: what its title or address names, or what another, different text names as well."""
    own = pages.where(F.arrays_overlap("codes", "title_codes")).select("doc_id")
    each = pages.select("doc_id", "text_hash", F.explode("codes").alias("code"))
    titles = pages.select("text_hash", F.explode("title_codes").alias("code"))
    spoken = each.select("code", "text_hash").unionByName(titles.select("code", "text_hash")).groupBy("code").agg((F.min("text_hash") < F.max("text_hash")).alias("elsewhere")).where("elsewhere")
    return own.unionByName(each.join(spoken, "code", "left_semi").select("doc_id")).distinct()


def residue(documents: DataFrame, hosts: int = 2, rounds: int = 3, monotone: float = 3.0, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, reason, n_alike, n_hosts, evidence): documents to exclude, and why.

    "field": a template field stands unfilled outside of code, even in a good text.

    All other reasons concern pages whose body names nothing: no coded name of its title or address, and none
    that a different text names too (a request number stands in one text only). The words of such a page, the
    number of addresses at which a body of the same words stands, and its site are weighed: for each, how
    often it occurs on pages in place of content against pages with content. Which of the nameless pages are
    in place of content isn't known beforehand, so the classes are estimated in `rounds` rounds of
    expectation and maximisation, starting with all of them; a page's own part in the counts is taken out
    before it is weighed. Where the evidence (log odds) is above 0 the page is reported: as "duplicate" if
    its body's words stand at `hosts` addresses or more, else as "mismatch". A body of at least four words whose effective
    number of words (one over the chance that two of them are the same) is at most `monotone` is "repetition".
    Address is source and system_id, the nearest thing to a URL here; site is the source.

    n_alike and n_hosts are counted over all documents: bodies of the same words, and their addresses. Null, empty and blank
    texts, and bodies without a word, are no case. Equal documents are reported each. No length limits anything.
    """
    spark = documents.sparkSession
    scratch = scratch or Scratch(spark, "residue")
    pages = scratch.save(page_terms(documents).withColumn("skeleton", F.xxhash64(F.array_sort(F.array_distinct("words")))), "pages")
    naming = scratch.save(_naming(pages), "naming")
    alike = pages.where(F.size("words") > 0).groupBy("skeleton", "host").agg(F.count("*").alias("n")).groupBy("skeleton").agg(F.sum("n").alias("n_alike"), F.count("*").alias("n_hosts"))

    worded = pages.where(F.size("words") > 0)
    nameless = scratch.save(worded.select("doc_id").join(naming, "doc_id", "left_anti"), "nameless")  # written, so that the planner knows its size before it moves words
    mute = worded.join(nameless, "doc_id", "left_semi").join(alike, "skeleton").select("doc_id", "site", "words", "n_alike", "n_hosts", "field")
    mute = scratch.save(mute, "mute")
    site = F.array(F.concat(F.lit("@"), F.coalesce("site", F.lit(""))))
    spread = F.when(F.col("n_hosts") >= hosts, F.array(F.lit("=hosts"))).otherwise(F.array().cast("array<string>"))
    terms = scratch.save(mute.select("doc_id", F.explode(F.concat(F.array_distinct("words"), spread, site)).alias("term")), "terms")

    every = worded.select(F.explode(F.concat(F.array_distinct("words"), site)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    many = alike.where(F.col("n_hosts") >= hosts).agg(F.coalesce(F.sum("n_alike"), F.lit(0)).alias("n")).select(F.lit("=hosts").alias("term"), "n")
    here = terms.groupBy("term").agg(F.count("*").alias("n_mute"))
    known = scratch.save(here.join(every.unionByName(many), "term").select("term", "n_mute", (F.col("n") - F.col("n_mute")).alias("n_good")), "known")
    n_mute = mute.count()
    n_good = worded.count() - n_mute

    odds = mute.select("doc_id", F.lit(1.0).alias("p"), F.lit(0.0).alias("evidence"))
    for k in range(rounds):
        bad = float(odds.agg(F.sum("p")).first()[0] or 0.0)
        weighed = terms.join(odds.select("doc_id", "p"), "doc_id")
        share = weighed.groupBy("term").agg(F.sum("p").alias("t"))
        rates = known.join(share, "term").select("term", "t", (F.col("n_good") + F.col("n_mute") - F.col("t")).alias("c"))
        against = F.log((F.col("t") - F.col("p") + 0.5) / (F.lit(bad + 1) - F.col("p"))) - F.log((F.col("c") - 1 + F.col("p") + 0.5) / (F.lit(n_good + n_mute - bad) + F.col("p")))
        total = weighed.join(rates, "term").groupBy("doc_id").agg(F.sum(against).alias("s"))
        prior = math.log((bad + 1) / (n_mute - bad + 1))
        evidence = F.col("s") + F.lit(prior)
        odds = scratch.save(total.select("doc_id", (1 / (1 + F.exp(-evidence))).alias("p"), evidence.alias("evidence")), f"odds{k}")

    each = mute.select("doc_id", F.explode("words").alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("square"))
    same = each.where((F.col("n") >= 4) & (F.col("n") * F.col("n") <= F.lit(monotone) * F.col("square"))).select("doc_id", F.lit(True).alias("same"))
    judged = mute.join(odds, "doc_id", "left").join(same, "doc_id", "left")
    reason = F.when(F.col("same"), "repetition").when(F.col("evidence") > 0, F.when(F.col("n_hosts") >= hosts, "duplicate").otherwise("mismatch"))
    pages_out = judged.where("NOT field").select("doc_id", reason.alias("reason"), "n_alike", "n_hosts", F.round("evidence", 3).alias("evidence")).where("reason IS NOT NULL")
    open_fields = pages.where("field").select("doc_id", F.lit("field").alias("reason"), F.lit(1).cast("bigint").alias("n_alike"), F.lit(1).cast("bigint").alias("n_hosts"), F.lit(None).cast("double").alias("evidence"))
    return pages_out.unionByName(open_fields)
