"""Queries over texts: search, links, lines, languages, duplicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import sentences
from ..functions import text as T
from ..operators import language, quality, search
from .registry import query

#: White space and word characters for DuckDB's regular expressions.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_\p{Mn}\p{Mc}]"
LINES = "SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS line_text FROM documents"


def _counted(expression: str) -> str:
    return f"SELECT doc_id, CAST({expression} AS INTEGER) AS matches FROM documents WHERE {expression} > 0"


@query("search_ci", _counted("len(regexp_extract_all(lower(text), 'the'))"))
def search_ci(read, spark):
    return search.count_matches(read("documents"), "the").select("doc_id", "matches")


@query("search_case", _counted("len(regexp_extract_all(text, 'The'))"))
def search_case(read, spark):
    return search.count_matches(read("documents"), "The", match_case=True).select("doc_id", "matches")


@query("search_whole_word", _counted(f"len(list_filter(regexp_extract_all(lower(text), '{WORD}+'), lambda w: w = 'the'))"))
def search_whole_word(read, spark):
    return search.count_matches(read("documents"), "the", whole_word=True).select("doc_id", "matches")


@query("search_ws", _counted(f"len(regexp_extract_all(lower(text), 'of{WS}+the'))"))
def search_ws(read, spark):
    return search.count_matches(read("documents"), " of  the ").select("doc_id", "matches")


@query("search_diacritics", _counted("len(regexp_extract_all(lower(strip_accents(text)), 'cion'))"))
def search_diacritics(read, spark):
    return search.count_matches(read("documents"), "ción", ignore_diacritics=True).select("doc_id", "matches")


@query("search_compat", _counted("len(regexp_extract_all(lower(translate(text, '‘’“”–—', '''''\"\"--')), '-'))"))
def search_compat(read, spark):
    return search.count_matches(read("documents"), "–", compatibility=True).select("doc_id", "matches")


@query("search_overlap", "SELECT doc_id, CAST(n AS INTEGER) AS matches FROM (SELECT doc_id, len(list_filter(range(1, length(text) + 1), lambda i: substr(lower(text), i, 3) = 'ana')) AS n FROM documents) WHERE n > 0")
def search_overlap(read, spark):
    return search.count_matches(read("documents"), "ana", overlapping=True).select("doc_id", "matches")


@query("search_per_line", f"SELECT doc_id, line, CAST(len(regexp_extract_all(lower(line_text), 'with')) AS INTEGER) AS matches FROM ({LINES}) WHERE contains(lower(line_text), 'with')")
def search_per_line(read, spark):
    return search.count_matches(search.lines_of(read("documents"), "doc_id"), "with", text="line_text").select("doc_id", "line", "matches")


@query(
    "search_top_docs",
    f"""WITH m AS (SELECT doc_id, text, CAST(len(list_filter(regexp_extract_all(lower(text), '{WORD}+'), lambda w: w = 'the')) AS INTEGER) AS matches FROM documents),
        t AS (SELECT * FROM m WHERE matches > 0 ORDER BY matches DESC, doc_id LIMIT 20)
        SELECT doc_id, matches, trim(regexp_replace(substr(text, greatest(instr(lower(text), 'the') - 50, 1), 53 + instr(lower(text), 'the') - greatest(instr(lower(text), 'the') - 50, 1)), '{WS}+', ' ', 'g')) AS snippet FROM t""",
)
def search_top_docs(read, spark):
    """The flagship: documents with most whole-word matches, with a snippet around the first occurrence."""
    found = search.count_matches(read("documents"), "the", whole_word=True)
    top = found.orderBy(F.col("matches").desc(), "doc_id").limit(20)
    start = T.first_place(F.col("text"), "the")
    return top.select("doc_id", "matches", T.snippet(F.col("text"), start, 3).alias("snippet"))


@query("search_truncated", "SELECT doc_id, CAST(least(n, 5) AS INTEGER) AS shown, n > 5 AS truncated FROM (SELECT doc_id, len(regexp_extract_all(lower(text), 'and')) AS n FROM documents) WHERE n > 0")
def search_truncated(read, spark):
    return search.limited_matches(read("documents"), "and", "doc_id", 5)


@query("search_wraparound", "SELECT doc_id, (doc_id - 100 + 1000000) % 1000000 AS wrapped FROM documents WHERE contains(lower(text), 'und')")
def search_wraparound(read, spark):
    return search.wrap_from(search.count_matches(read("documents"), "und"), "doc_id", 100, 1_000_000).select("doc_id", "wrapped")


@query(
    "search_positions",
    """WITH p AS (SELECT doc_id, string_split(lower(text), 'tion') AS parts FROM documents WHERE contains(lower(text), 'tion')),
       e AS (SELECT doc_id, unnest(range(1, len(parts))) AS ordinal, parts FROM p)
       SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, CAST(list_sum(list_transform(parts[1:ordinal], lambda x: length(x))) + 4 * (ordinal - 1) + 1 AS BIGINT) AS start, 4 AS length FROM e""",
)
def search_positions(read, spark):
    found = search.match_starts(read("documents"), "tion", "doc_id")
    return found.select("doc_id", "ordinal", F.col("start").cast("long").alias("start"), "length")


@query(
    "search_source_positions",
    """WITH d AS (SELECT row_number() OVER () AS row, doc_id, translate(replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)), 'TO', chr(65332) || chr(65327)) AS text FROM documents),
       c AS (SELECT row, doc_id, unnest(range(1, length(text) + 1)) AS place, unnest(string_split(text, '')) AS own FROM (SELECT * FROM d WHERE length(text) > 0)),
       k AS (SELECT row, doc_id, place, row_number() OVER (PARTITION BY row ORDER BY place) AS nth, CASE own WHEN chr(65332) THEN 't' WHEN chr(65327) THEN 'o' ELSE lower(strip_accents(own)) END AS own
             FROM c WHERE own NOT IN (chr(769), chr(771))),
       n AS (SELECT *, lead(own) OVER w AS own2, lead(own, 2) OVER w AS own3, lead(place, 2) OVER w AS last_place FROM k WINDOW w AS (PARTITION BY row ORDER BY nth))
       SELECT doc_id, CAST(row_number() OVER (PARTITION BY row ORDER BY nth) AS INTEGER) AS ordinal, CAST(nth AS INTEGER) AS start, 3 AS length, CAST(place AS INTEGER) AS source_start, CAST(last_place - place + 1 AS INTEGER) AS source_length
       FROM n WHERE own = 'e' AND own2 = 't' AND own3 = 'o'""",
)
def search_source_positions(read, spark):
    """Places in the texts themselves, with accents as marks of their own and full-width letters, of a search that folds both."""
    marked = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ñ"), F.lit("n\u0303"))
    docs = read("documents").select("doc_id", F.translate(marked, "TO", "\uff34\uff2f").alias("text"))
    return search.match_starts(docs, "éto", "doc_id", ignore_diacritics=True, compatibility=True)


@query("snippet", f"SELECT doc_id, trim(regexp_replace(substr(text, greatest(p - 50, 1), 54 + p - greatest(p - 50, 1)), '{WS}+', ' ', 'g')) AS snippet FROM (SELECT *, instr(lower(text), 'with') AS p FROM documents) WHERE p > 0")
def snippet(read, spark):
    return search.first_snippets(read("documents"), "with", "doc_id")


@query("keyword_and_filter", "SELECT doc_id FROM documents WHERE (contains(lower(strip_accents(coalesce(text, ''))), 'cion') OR contains(lower(source), 'cion') OR contains(lower(lang), 'cion')) AND (contains(lower(strip_accents(coalesce(text, ''))), 'src1') OR contains(lower(source), 'src1') OR contains(lower(lang), 'src1'))")
def keyword_and_filter(read, spark):
    return search.keyword_filter(read("documents"), "CIÓN src1", ["text", "source", "lang"]).select("doc_id")


EMAIL = T.EMAIL.replace("'", "''")


@query("mail_links", f"SELECT doc_id, unnest(regexp_extract_all(text, '{EMAIL}')) AS address FROM documents")
def mail_links(read, spark):
    return read("documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("address"))


@query("web_links", r"""SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?:href|src)="[^"]*"'), lambda x: regexp_replace(regexp_extract(x, '"([^"]*)"', 1), '[.,;:!?'']+$', ''))) AS link FROM pages""")
def web_links(read, spark):
    found = F.regexp_extract_all("html", F.lit(r'(?:href|src)="([^"]*)"'), F.lit(1))
    return read("pages").select("page_id", F.explode(F.transform(found, lambda x: F.regexp_replace(x, r"[.,;:!?']+$", ""))).alias("link"))


@query(
    "html_plain_text",
    rf"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '{WS}+', ' ', 'g'), ' ') AS plain FROM pages""",
)
def html_plain_text(read, spark):
    return read("pages").select("page_id", T.plain_text(F.col("html")).alias("plain"))


@query("hyphen_join", r"SELECT doc_id, regexp_replace(regexp_replace(text, '(\p{L})[-\x{2010}]\r?\n(\p{Ll})', '\1\2', 'g'), '\x{ad}\r?\n?', '', 'g') AS joined FROM documents")
def hyphen_join(read, spark):
    return read("documents").select("doc_id", T.join_hyphens(F.col("text")).alias("joined"))


@query("line_signature", rf"SELECT doc_id, line, trim(regexp_replace(lower(regexp_replace(line_text, '\p{{Nd}}', '#', 'g')), '{WS}+', ' ', 'g'), ' ') AS signature FROM ({LINES})")
def line_signature(read, spark):
    return search.lines_of(read("documents"), "doc_id").select("doc_id", "line", T.line_signature(F.col("line_text")).alias("signature"))


@query(
    "repeated_lines",
    f"""WITH l AS (SELECT DISTINCT d.source, l.doc_id, l.line_text FROM ({LINES}) l JOIN documents d USING (doc_id) WHERE l.line_text <> ''),
        t AS (SELECT source, count(DISTINCT doc_id) AS n FROM l GROUP BY source)
        SELECT source, line_text, count(*) AS docs FROM l JOIN t USING (source) GROUP BY source, line_text, n HAVING count(*) >= 2 AND count(*) >= 0.02 * n""",
)
def repeated_lines(read, spark):
    docs = read("documents")
    lines = docs.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line_text"))
    return quality.repeated_lines(lines, "doc_id", "line_text", "source", 2, 0.02)


@query("repeated_lines_in_doc", f"SELECT doc_id, line_text, count(*) AS times FROM ({LINES}) WHERE line_text <> '' GROUP BY ALL HAVING count(*) > 1")
def repeated_lines_in_doc(read, spark):
    return search.lines_of(read("documents"), "doc_id").where("line_text <> ''").groupBy("doc_id", "line_text").agg(F.count(F.lit(1)).alias("times")).where("times > 1")


#: Lines of documents, and one for each part as reports print them: page numbers, captions, items, notes.
FORMS = ["CAST(p_size AS {text})", "concat('Page ', p_size, ' of 50')", "concat('Table ', p_size, ': ', p_name)", "concat(p_size, '. ', p_name)", "concat('* ', p_name)", "concat('- ', p_size, ' -')", "concat('Fig. ', p_name)"]
PRINTED_LINE = "CASE p_partkey % 7 " + " ".join(f"WHEN {i} THEN {form}" for i, form in enumerate(FORMS)) + " END"
PRINTED = f"{LINES} UNION ALL SELECT -p_partkey, 0, {PRINTED_LINE.format(text='VARCHAR')} FROM part"


def _printed(read):
    parts = read("part").select((-F.col("p_partkey")).alias("doc_id"), F.lit(0).alias("line"), F.expr(PRINTED_LINE.format(text="STRING")).alias("line_text"))
    return search.lines_of(read("documents"), "doc_id").unionByName(parts)


@query(
    "page_number_lines",
    rf"""WITH l AS (SELECT doc_id, line, regexp_replace(regexp_replace(line_text, '^[\t-\r \-–—|·•\[\]()]+', ''), '[\t-\r \-–—|·•\[\]()]+$', '') AS bare FROM ({PRINTED})),
         b AS (SELECT *, regexp_replace(bare, '(?i)^page[\t-\r ]*', '') AS body FROM l)
         SELECT doc_id, line FROM b WHERE length(bare) BETWEEN 1 AND 16 AND ((regexp_matches(body, '^[0-9/oOfF\t-\r ]+$') AND regexp_matches(body, '[0-9]')) OR regexp_matches(body, '^[ivxlcIVXLC]+$'))""",
)
def page_number_lines(read, spark):
    return _printed(read).where(T.is_page_number(F.col("line_text"))).select("doc_id", "line")


@query("page_number_forms", rf"SELECT doc_id, line FROM ({PRINTED}) WHERE regexp_replace(trim(regexp_replace(lower(regexp_replace(line_text, '\p{{Nd}}', '#', 'g')), '{WS}+', ' ', 'g'), ' '), '#+', '#', 'g') IN ('#', 'page #', 'page # of #', '# of #', '# / #', '#/#', 'p. #', 'p #', '- # -', '– # –', '— # —', '[#]', '(#)')")
def page_number_forms(read, spark):
    return _printed(read).where(T.is_page_number_form(T.pagination_key(F.col("line_text")))).select("doc_id", "line")


@query("caption_lines", rf"SELECT doc_id, line FROM ({PRINTED}) WHERE regexp_matches(line_text, '^(?i:figure|fig\.|table|chart|listing|plate|exhibit){WS}*([0-9]|[A-Z][.:])')")
def caption_lines(read, spark):
    return _printed(read).where(T.is_caption(F.col("line_text"))).select("doc_id", "line")


@query("list_item_lines", rf"SELECT doc_id, line FROM ({PRINTED}) WHERE regexp_matches(line_text, '^(?:[{T.BULLETS.replace('-', chr(92) + '-')}](?: |[^{T.BULLETS.replace('-', chr(92) + '-')}\p{{L}}\p{{N}}])|\(*(?:[a-z]|[0-9]{{1,3}})[.)] )')")
def list_item_lines(read, spark):
    return _printed(read).where(T.starts_item(F.col("line_text"))).select("doc_id", "line")


@query("footnote_lines", f"SELECT doc_id, line FROM ({PRINTED}) WHERE regexp_matches(line_text, '^[0-9{T.FOOTNOTE_MARKS}]')")
def footnote_lines(read, spark):
    return _printed(read).where(T.starts_footnote(F.col("line_text"))).select("doc_id", "line")


@query("sentence_end_lines", f"SELECT doc_id, count(*) AS ended FROM ({LINES}) WHERE regexp_matches(line_text, '[.?!:]$') GROUP BY doc_id")
def sentence_end_lines(read, spark):
    ended = F.size(F.filter(F.split("text", "\n"), T.ends_sentence)).cast("long")
    return read("documents").select("doc_id", ended.alias("ended")).where("ended > 0")


@query("speech_text", r"SELECT doc_id, trim(regexp_replace(regexp_replace(text, '-[\r\n]+', '', 'g'), '[\x00-\x20\x7f]+', ' ', 'g'), ' ') AS spoken FROM documents")
def speech_text(read, spark):
    """Whole texts as they are read out: hyphenated lines joined, white space and control characters as one space."""
    return read("documents").select("doc_id", sentences.to_speech(F.col("text")).alias("spoken"))


@query("word_tokens", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{WORD}+')) AS INTEGER) AS words FROM documents")
def word_tokens(read, spark):
    return read("documents").select("doc_id", F.size(T.words(F.col("text"))).alias("words"))


@query(
    "misspelled_anti",
    f"""WITH d AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}+'))) AS word FROM documents),
        known AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORD}+')) AS word FROM benchmark)
        SELECT doc_id, count(*) AS unknown FROM d ANTI JOIN known USING (word) WHERE length(word) >= 2 AND NOT regexp_matches(word, '[0-9]') GROUP BY doc_id""",
)
def misspelled_anti(read, spark):
    """Distinct words of a document that aren't in the vocabulary; words with digits and single letters don't count."""
    words = lambda df: F.explode(F.array_distinct(T.words(F.lower("text")))).alias("word")
    docs, known = read("documents"), read("benchmark")
    rows = docs.select("doc_id", words(docs)).where((F.length("word") >= 2) & ~F.col("word").rlike("[0-9]"))
    return rows.join(known.select(words(known)).distinct(), "word", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("unknown"))


def _guess_sql() -> str:
    votes = ", ".join(f"{{'hits': len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in known.split())}))), 'ord': {-i}, 'lang': '{lang}'}}" for i, (lang, known) in enumerate(language.FUNCTION_WORDS.items()))
    return rf"""WITH w AS (SELECT doc_id, lang, len(regexp_extract_all(text, '\p{{L}}')) AS letters, list_filter(regexp_extract_all(lower(text), '\p{{L}}+'), lambda w: length(w) <= 12) AS words FROM documents),
        v AS (SELECT doc_id, lang, letters, list_reverse_sort([{votes}]) AS votes FROM w)
        SELECT doc_id, lang, CASE WHEN letters >= 12 AND votes[1].hits >= 3 AND votes[1].hits >= votes[2].hits * 1.3 THEN votes[1].lang END AS guess FROM v"""


@query("language_guess", f"SELECT doc_id, guess FROM ({_guess_sql()})")
def language_guess(read, spark):
    return language.guess_language(read("documents")).select("doc_id", "guess")


@query("language_agreement", f"SELECT lang, guess, count(*) AS docs FROM ({_guess_sql()}) GROUP BY ALL")
def language_agreement(read, spark):
    return language.guess_language(read("documents")).groupBy("lang", "guess").agg(F.count(F.lit(1)).alias("docs"))


@query("dedup_exact", "SELECT sha256(text) AS digest, min(doc_id) AS canonical, count(*) AS copies FROM documents GROUP BY 1")
def dedup_exact(read, spark):
    return quality.content_groups(read("documents"), "doc_id", "text")


@query("dedup_alias_map", "SELECT doc_id, canonical FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS canonical FROM documents) WHERE doc_id <> canonical")
def dedup_alias_map(read, spark):
    return quality.alias_map(read("documents"), "doc_id", "text")


@query("benchmark_hits", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def benchmark_hits(read, spark):
    return search.phrase_hits(read("documents"), read("benchmark"), "doc_id", "item_id")


@query(
    "rule_report",
    """WITH r AS (SELECT doc_id, unnest([{'rule': 'has text', 'ok': length(text) > 0}, {'rule': 'n_chars agrees', 'ok': length(text) = n_chars}, {'rule': 'no tabs', 'ok': NOT contains(text, chr(9))}, {'rule': 'short', 'ok': n_chars <= 10000}]) AS r FROM documents)
       SELECT r.rule AS rule, count(*) FILTER (WHERE NOT coalesce(r.ok, false)) AS failures, min(doc_id) FILTER (WHERE NOT coalesce(r.ok, false)) AS first_context,
              CASE WHEN count(*) FILTER (WHERE NOT coalesce(r.ok, false)) > 0 THEN 'failed' ELSE 'passed' END AS status FROM r GROUP BY 1""",
)
def rule_report(read, spark):
    rules = {"has text": F.length("text") > 0, "n_chars agrees": F.length("text") == F.col("n_chars"), "no tabs": ~F.col("text").contains("\t"), "short": F.col("n_chars") <= 10_000}
    return quality.rule_report(read("documents"), "doc_id", rules)


@query("diagnostics_by_code", "SELECT code, count(*) AS found FROM (SELECT 'long' AS code FROM documents WHERE n_chars > 10000 UNION ALL SELECT 'mail' FROM documents WHERE contains(text, '@') UNION ALL SELECT 'no stop' FROM documents WHERE NOT contains(text, '.')) GROUP BY code")
def diagnostics_by_code(read, spark):
    text = F.col("text")
    found = quality.diagnostics(read("documents"), "doc_id", {"long": F.col("n_chars") > 10_000, "mail": text.contains("@"), "no stop": ~text.contains(".")})
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("found"))


@query("accessibility_rollup", "SELECT lang, quality, count(*) AS docs FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, quality)")
def accessibility_rollup(read, spark):
    return read("documents").select("doc_id", "lang").join(read("labels"), "doc_id").rollup("lang", "quality").agg(F.count(F.lit(1)).alias("docs"))


@query("redact_spans", f"SELECT doc_id, regexp_replace(text, '{EMAIL}', '[mail]', 'g') AS redacted, CAST(len(regexp_extract_all(text, '{EMAIL}')) AS INTEGER) AS spans FROM documents WHERE regexp_matches(text, '{EMAIL}')")
def redact_spans(read, spark):
    text = F.col("text")
    return read("documents").where(text.rlike(T.EMAIL)).select("doc_id", F.regexp_replace(text, T.EMAIL, "[mail]").alias("redacted"), F.regexp_count(text, F.lit(T.EMAIL)).alias("spans"))


@query("metadata_edit", "SELECT doc_id, CASE WHEN edit IS NULL THEN source WHEN edit = '' THEN NULL ELSE edit END AS source FROM (SELECT doc_id, source, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE upper(source) END AS edit FROM documents)")
def metadata_edit(read, spark):
    """A null edit keeps a value, an empty one removes it."""
    edit = F.when(F.col("doc_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.upper("source"))
    return read("documents").withColumn("edit", edit).select("doc_id", F.when(F.col("edit").isNull(), F.col("source")).when(F.col("edit") != "", F.col("edit")).alias("source"))


@query("info_resolve", "SELECT d.doc_id, CASE WHEN coalesce(l.quality, 0) = 1 THEN coalesce(nullif(trim(d.lang), ''), d.source) ELSE coalesce(nullif(trim(d.source), ''), d.lang) END AS resolved FROM documents d LEFT JOIN labels l USING (doc_id)")
def info_resolve(read, spark):
    """A flag decides which of two sources comes first; blanks count as missing."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    rows = read("documents").select("doc_id", "lang", "source").join(read("labels"), "doc_id", "left")
    newer = F.coalesce("quality", F.lit(0)) == 1
    return rows.select("doc_id", F.when(newer, F.coalesce(filled(F.col("lang")), "source")).otherwise(F.coalesce(filled(F.col("source")), "lang")).alias("resolved"))


@query("sentence_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS INTEGER) AS pieces FROM documents")
def sentence_counts(read, spark):
    return read("documents").select("doc_id", F.regexp_count("text", F.lit(r"[^.!?\n]+[.!?]*")).alias("pieces"))


@query("bounds_of_lines", f"SELECT doc_id, count(*) AS lines, max(length(line_text)) AS widest FROM ({LINES}) GROUP BY doc_id")
def bounds_of_lines(read, spark):
    lines = F.split("text", "\n")
    return read("documents").where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.array_max(F.transform(lines, F.length)).cast("long").alias("widest"))


@query("matches_per_page", f"SELECT doc_id, list({{'line': line, 'n': n}} ORDER BY line) AS pages FROM (SELECT doc_id, line, CAST(len(regexp_extract_all(lower(line_text), 'the')) AS INTEGER) AS n FROM ({LINES})) WHERE n > 0 GROUP BY doc_id")
def matches_per_page(read, spark):
    pages = search.line_values(F.col("text"), lambda x: search.match_count(x, "the"), lambda n: n > 0)
    return read("documents").select("doc_id", pages.alias("pages")).where("size(pages) > 0")


@query("first_line_of_source", "SELECT source, doc_id, first_line FROM (SELECT source, doc_id, string_split(text, chr(10))[1] AS first_line, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def first_line_of_source(read, spark):
    first = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return read("documents").withColumn("n", first).where("n = 1").select("source", "doc_id", F.substring_index("text", "\n", 1).alias("first_line"))
