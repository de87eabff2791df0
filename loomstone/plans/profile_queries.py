"""Named queries of the profiling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as op
from . import inputs
from .inputs import PAIRS_SQL
from .registry import query

_WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NOT_WS = _WS.replace("[", "[^", 1)

_COUNTS_SQL = rf"""
  length(text)::BIGINT AS chars,
  (length(text) - length(replace(text, chr(10), '')))::BIGINT AS newlines,
  CASE WHEN text = '' OR ends_with(text, chr(10)) THEN 0 ELSE 1 END AS open_line,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_NOT_WS}')))::BIGINT AS non_blank_lines,
  len(regexp_extract_all(text, '{_NOT_WS}+'))::BIGINT AS words,
  (length(text) - length(regexp_replace(text, '[\x{{4e00}}-\x{{9fff}}]', '', 'g')))::BIGINT AS cjk,
  (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::BIGINT AS ascii_letters,
  (length(text) - length(regexp_replace(text, '\p{{Nd}}', '', 'g')))::BIGINT AS digits,
  (length(text) - length(regexp_replace(text, '[^\p{{L}}\p{{N}}\s\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]', '', 'g')))::BIGINT AS punctuation,
  (length(text) - length(regexp_replace(text, '{_WS}', '', 'g')))::BIGINT AS spaces
"""
_LANG_SQL = """CASE WHEN cjk * 10 > ascii_letters * 3 THEN CASE WHEN cjk > ascii_letters THEN 'zh' ELSE 'zh-en' END
  WHEN ascii_letters > 0 THEN 'en' ELSE 'other' END"""
_SUMS_SQL = """source, sum(chars)::BIGINT AS chars, sum(newlines + open_line)::BIGINT AS lines,
  sum(non_blank_lines)::BIGINT AS non_blank_lines, sum(words)::BIGINT AS words, sum(cjk)::BIGINT AS cjk,
  sum(ascii_letters)::BIGINT AS ascii_letters, sum(digits)::BIGINT AS digits,
  sum(punctuation)::BIGINT AS punctuation, sum(spaces)::BIGINT AS spaces"""


@query(
    "text_stats_doc",
    f"""WITH c AS (SELECT doc_id, {_COUNTS_SQL} FROM documents)
    SELECT doc_id, chars, newlines + open_line AS lines, non_blank_lines, words, cjk, ascii_letters, digits,
      punctuation, spaces, {_LANG_SQL} AS language, cjk + words AS rough_tokens FROM c""",
)
def text_stats_doc(spark, sf_dir):
    return op.text_stats(inputs.documents(spark, sf_dir, "doc_id", "text"), "text", "doc_id")


@query(
    "text_stats_source",
    f"""WITH c AS (SELECT source, {_COUNTS_SQL} FROM documents), s AS (SELECT {_SUMS_SQL} FROM c GROUP BY source)
    SELECT *, {_LANG_SQL} AS language, cjk + words AS rough_tokens FROM s""",
)
def text_stats_source(spark, sf_dir):
    return op.text_stats_by(inputs.documents(spark, sf_dir, "source", "text"), "text", "source")


@query(
    "text_stats_simple",
    f"""WITH c AS (SELECT doc_id, {_COUNTS_SQL} FROM documents)
    SELECT doc_id, chars, newlines + 1 AS lines, words, cjk, ascii_letters, digits, spaces,
      chars - cjk - ascii_letters - digits - spaces AS other, cjk + words AS rough_tokens,
      CASE WHEN cjk > ascii_letters THEN 'zh' WHEN ascii_letters > 0 THEN 'en' ELSE 'other' END AS primary_language
    FROM c""",
)
def text_stats_simple(spark, sf_dir):
    return op.simple_text_stats(inputs.documents(spark, sf_dir, "doc_id", "text"), "text", "doc_id")


@query(
    "language_guess",
    f"""WITH c AS (SELECT lang, {_COUNTS_SQL} FROM documents)
    SELECT lang, {_LANG_SQL} AS guess, count(*) AS n FROM c GROUP BY ALL""",
)
def language_guess(spark, sf_dir):
    stats = op.text_stats(inputs.documents(spark, sf_dir, "lang", "text"), "text", "lang")
    return stats.groupBy("lang", F.col("language").alias("guess")).agg(F.count("*").alias("n"))


_LINES_SQL = f"""
lines AS (SELECT source, length(line) AS len FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
          WHERE regexp_matches(line, '{_NOT_WS}')),
dist AS (SELECT source, count(*) AS line_count, min(len)::BIGINT AS min_length, max(len)::BIGINT AS max_length,
           sum(len)::BIGINT / count(*) AS avg_length,
           (percentile_disc(0.5) WITHIN GROUP (ORDER BY len DESC))::BIGINT AS median_length
         FROM lines GROUP BY source),
bins AS (SELECT source, min_length AS low, greatest(1, (max_length - min_length + 1) // 10) AS width, unnest(range(10)) AS bin FROM dist),
filled AS (SELECT l.source, least((len - min_length) // greatest(1, (max_length - min_length + 1) // 10), 9) AS bin, count(*) AS n
           FROM lines l JOIN dist d USING (source) GROUP BY ALL),
hist AS (SELECT source, bin::BIGINT AS bin, concat(low + bin * width, '-', low + (bin + 1) * width - 1) AS range, coalesce(n, 0) AS n
         FROM bins LEFT JOIN filled USING (source, bin))
"""


@query("line_length_dist", f"WITH {_LINES_SQL} SELECT * FROM dist")
def line_length_dist(spark, sf_dir):
    counts = op.line_length_counts(inputs.documents(spark, sf_dir, "source", "text"), "text", "source")
    return op.line_length_distribution(counts, "source")


@query("line_length_hist", f"WITH {_LINES_SQL} SELECT * FROM hist")
def line_length_hist(spark, sf_dir):
    counts = op.line_length_counts(inputs.documents(spark, sf_dir, "source", "text"), "text", "source")
    return op.line_length_histogram(counts, "source")


@query(
    "top_chars",
    """SELECT ch AS "char", count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents)
    WHERE ch <> '' GROUP BY ch ORDER BY n DESC, ch LIMIT 30""",
)
def top_chars(spark, sf_dir):
    return op.top_k(op.char_counts(inputs.documents(spark, sf_dir, "text"), "text"), "char")


_WORDS_SQL = r"unnest(regexp_extract_all(lower(text), '[\x{4e00}-\x{9fff}]|[a-zA-Z]+'))"


@query(
    "top_words",
    f"SELECT word, count(*) AS n FROM (SELECT {_WORDS_SQL} AS word FROM documents) GROUP BY word ORDER BY n DESC, word LIMIT 30",
)
def top_words(spark, sf_dir):
    return op.top_k(op.word_counts(inputs.documents(spark, sf_dir, "text"), "text"), "word")


@query(
    "word_counts",
    "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents) GROUP BY word",
)
def word_counts(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))
    return (
        inputs.documents(spark, sf_dir, "text")
        .select(F.explode(words).alias("word"))
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )


@query(
    "dataset_report",
    f"""WITH {_LINES_SQL}, c AS (SELECT source, {_COUNTS_SQL} FROM documents), s AS (SELECT {_SUMS_SQL} FROM c GROUP BY source),
    h AS (SELECT source, string_agg(range || ':' || n, ' ' ORDER BY bin) AS histogram FROM hist GROUP BY source),
    chars AS (SELECT source, ch, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, ch) AS rank
      FROM (SELECT source, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY source, ch),
    words AS (SELECT source, word, count(*) AS n, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, word) AS rank
      FROM (SELECT source, {_WORDS_SQL} AS word FROM documents) GROUP BY source, word),
    tc AS (SELECT source, string_agg(ch || '=' || n, '|' ORDER BY rank) AS top_chars FROM chars WHERE rank <= 30 GROUP BY source),
    tw AS (SELECT source, string_agg(word || '=' || n, '|' ORDER BY rank) AS top_words FROM words WHERE rank <= 30 GROUP BY source)
    SELECT s.*, {_LANG_SQL} AS language, cjk + words AS rough_tokens, line_count, min_length, max_length, avg_length,
      median_length, histogram, top_chars, top_words
    FROM s LEFT JOIN dist USING (source) LEFT JOIN h USING (source) LEFT JOIN tc USING (source) LEFT JOIN tw USING (source)""",
)
def dataset_report(spark, sf_dir):
    return op.dataset_report(inputs.documents(spark, sf_dir, "source", "text"), "text", "source")


_CELLS_SQL = """
cells AS (
  SELECT c_custkey AS ord, 0 AS pos, 'c_custkey' AS name, 'int' AS type, c_custkey::VARCHAR AS value FROM customer UNION ALL
  SELECT c_custkey, 1, 'c_name', 'str', c_name FROM customer UNION ALL
  SELECT c_custkey, 2, 'c_nationkey', 'int', c_nationkey::VARCHAR FROM customer UNION ALL
  SELECT c_custkey, 3, 'c_acctbal', 'float', c_acctbal::VARCHAR FROM customer UNION ALL
  SELECT c_custkey, 4, 'c_mktsegment', 'str', c_mktsegment FROM customer)"""
_PROFILE_SQL = """
firsts AS (SELECT name, string_agg(substr(value, 1, 200), ' | ' ORDER BY ord) AS samples FROM
  (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ord) AS rank FROM cells) WHERE rank <= 5 GROUP BY name),
stats AS (SELECT name, min(pos)::INT AS pos, count(*) AS row_count, count(*) FILTER (trim(value) <> '') AS non_empty,
  coalesce(sum(length(substr(value, 1, 200))) FILTER (trim(value) <> ''), 0)::BIGINT / greatest(count(*) FILTER (trim(value) <> ''), 1) AS avg_len,
  count(*) FILTER (trim(value) <> '') * 100 / count(*) AS fill_rate, mode(type) AS primary_type FROM cells GROUP BY name),
profile AS (SELECT * FROM stats LEFT JOIN firsts USING (name)),
roles AS (SELECT *, primary_type = 'str' AND round(avg_len, 1) > 10 AND round(fill_rate, 1) > 50 AS is_text,
  primary_type = 'list' OR (primary_type = 'str' AND regexp_matches(lower(name), 'conversation|messages|dialog')) AS is_conversation
  FROM profile)"""


@query("column_profile", f"WITH {_CELLS_SQL}, {_PROFILE_SQL} SELECT * FROM profile")
def column_profile(spark, sf_dir):
    customers = inputs.table(spark, sf_dir, "customer")
    first_rows = customers.orderBy("c_custkey").limit(op.SAMPLE_ROWS)
    return op.column_profile(
        op.cells_of_columns(customers, "c_custkey"), op.cells_of_columns(first_rows, "c_custkey")
    )


@query(
    "column_profile_first_rows",
    f"""WITH {_CELLS_SQL.replace("cells AS", "all_cells AS", 1)},
    cells AS (SELECT * FROM all_cells WHERE ord IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 20)),
    {_PROFILE_SQL} SELECT * FROM profile""",
)
def column_profile_first_rows(spark, sf_dir):
    """The quick form: only the first twenty rows of the file are looked at."""
    first_rows = inputs.table(spark, sf_dir, "customer").orderBy("c_custkey").limit(op.SAMPLE_ROWS)
    cells = op.cells_of_columns(first_rows, "c_custkey")
    return op.column_profile(cells, cells)


# A key's place is its place in the record as written.
_RECORD_CELLS_SQL = f"""
{PAIRS_SQL.strip()}, rec AS (SELECT conv_id * 100 + turn AS ord, (conv_id + turn) % 6 AS fmt, * FROM pairs),
cells AS (
  SELECT ord, 0 AS pos, 'instruction' AS name, 'str' AS type, user_text AS value FROM rec WHERE fmt = 0 UNION ALL
  SELECT ord, 1, 'input', 'str', '' FROM rec WHERE fmt = 0 UNION ALL
  SELECT ord, 2, 'output', 'str', assistant_text FROM rec WHERE fmt = 0 UNION ALL
  SELECT ord, 0, 'system_prompt', 'str', 'You are helper ' || (conv_id % 3) FROM rec WHERE fmt = 1 UNION ALL
  SELECT ord, 1, 'question', 'str', user_text FROM rec WHERE fmt = 1 UNION ALL
  SELECT ord, 2, 'response', 'str', assistant_text FROM rec WHERE fmt = 1 UNION ALL
  SELECT ord, 0, 'prompt', 'str', user_text FROM rec WHERE fmt = 2 UNION ALL
  SELECT ord, 1, 'completion', 'str', assistant_text FROM rec WHERE fmt = 2 UNION ALL
  SELECT ord, 0, 'query', 'str', user_text FROM rec WHERE fmt = 3 UNION ALL
  SELECT ord, 1, 'answer', 'str', assistant_text FROM rec WHERE fmt = 3 UNION ALL
  SELECT ord, 0, 'conversations', 'list', '[' || 'turns' || ']' FROM rec WHERE fmt = 4 UNION ALL
  SELECT ord, 0, 'title', 'str', user_text FROM rec WHERE fmt = 5 UNION ALL
  SELECT ord, 1, 'body', 'str', assistant_text FROM rec WHERE fmt = 5)
"""


def _record_profile(spark, sf_dir):
    lines = inputs.foreign_rows(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("ord"), "line")
    first = lines.orderBy("ord").limit(op.SAMPLE_ROWS)
    return op.column_profile(op.cells_of_records(lines, "line", "ord"), op.cells_of_records(first, "line", "ord"))


@query(
    "column_roles",
    f"""WITH {_RECORD_CELLS_SQL}, {_PROFILE_SQL}
    SELECT name, row_count, non_empty, primary_type, is_text, is_conversation FROM roles""",
)
def column_roles(spark, sf_dir):
    roles = op.with_column_roles(_record_profile(spark, sf_dir))
    return roles.select("name", "row_count", "non_empty", "primary_type", "is_text", "is_conversation")


@query(
    "column_suggest",
    f"""WITH {_RECORD_CELLS_SQL}, {_PROFILE_SQL},
    ranked AS (SELECT *, list_position(['text', 'content', 'output', 'instruction', 'input', 'question', 'answer', 'response',
      'prompt', 'completion', 'story', 'document', 'passage', 'sentence'], name) AS known FROM roles WHERE is_text)
    SELECT name, row_number() OVER (ORDER BY CASE WHEN known > 0 THEN known ELSE 1000 END, pos, name) AS rank FROM ranked""",
)
def column_suggest(spark, sf_dir):
    return op.suggest_columns(_record_profile(spark, sf_dir))


@query(
    "row_counts_by_source",
    f"""SELECT source, count(*) AS records,
      sum(len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_NOT_WS}'))))::BIGINT AS jsonl_rows,
      sum(greatest(len(string_split(text, chr(10))) - 1, 0))::BIGINT AS csv_rows FROM documents GROUP BY source""",
)
def row_counts_by_source(spark, sf_dir):
    return op.row_counts(inputs.documents(spark, sf_dir, "source", "text"), "text", "source")
