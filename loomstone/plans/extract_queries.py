"""Named queries of sources, extraction and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import convert, extract as op, packing
from ..sources import files, manifest
from . import inputs
from .inputs import PAIRS_SQL
from .registry import query

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _fields(spark, sf_dir):
    """Documents as records of three string columns, some blank and some missing."""
    return inputs.documents(spark, sf_dir, "doc_id", "source", "lang", "text").select(
        "doc_id",
        F.concat(F.lit(" "), F.col("lang"), F.lit(" ")).alias("a"),
        F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE source END").alias("b"),
        F.expr("CASE WHEN doc_id % 5 <> 0 THEN text END").alias("c"),
    )


_FIELDS_SQL = f"""fields AS (SELECT doc_id, ' ' || lang || ' ' AS a, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN '  ' ELSE source END AS b,
  CASE WHEN doc_id % 5 <> 0 THEN text END AS c FROM documents)"""


def _trim(c):
    return f"trim({c}, {_WS})"


@query(
    "extract_columns_csv_rule",
    f"WITH {_FIELDS_SQL} SELECT doc_id, concat_ws('|', nullif({_trim('a')}, ''), nullif({_trim('b')}, ''), nullif({_trim('c')}, '')) AS text FROM fields",
)
def extract_columns_csv_rule(spark, sf_dir):
    return op.extract_columns(_fields(spark, sf_dir), ["a", "b", "c"], "|").select("doc_id", "text")


@query(
    "extract_columns_json_rule",
    f"""WITH {_FIELDS_SQL} SELECT doc_id, concat_ws('|', CASE WHEN a <> '' THEN {_trim('a')} END, CASE WHEN b <> '' THEN {_trim('b')} END,
      CASE WHEN c <> '' THEN {_trim('c')} END) AS text FROM fields""",
)
def extract_columns_json_rule(spark, sf_dir):
    return op.extract_columns(_fields(spark, sf_dir), ["a", "b", "c"], "|", keep_blank=True).select("doc_id", "text")


@query(
    "per_source_column_config",
    f"""SELECT doc_id, CASE WHEN substr(source, 4)::INT % 3 = 0 THEN lang || chr(10) || {_trim('text')}
      WHEN substr(source, 4)::INT % 3 = 1 THEN source ELSE text END AS text FROM documents""",
)
def per_source_column_config(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir, "doc_id", "source", "lang", "text")
    number = F.substring("source", 4, 9).cast("int")
    config = docs.select("source").distinct().select(
        "source",
        F.when(number % 3 == 0, F.array(F.lit("lang"), F.lit("text")))
        .when(number % 3 == 1, F.array(F.lit("source"), F.lit("missing")))
        .alias("columns"),
    ).where("columns IS NOT NULL")
    rows = docs.withColumn("fields", F.create_map(F.lit("lang"), F.col("lang"), F.lit("text"), F.col("text"), F.lit("source"), F.col("source")))
    return op.extract_by_config(rows, config, "source", "fields", "text").select("doc_id", "text")


@query(
    "record_separator_stream",
    """WITH r AS (SELECT source, doc_id, CASE WHEN lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) IS NULL THEN '' ELSE chr(10) || chr(10) END || text AS text FROM documents)
    SELECT source, doc_id, text, (sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) - length(text))::BIGINT AS start FROM r""",
)
def record_separator_stream(spark, sf_dir):
    """The records of each file with their separators, and where each starts in the joined file."""
    docs = inputs.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    return packing.place_records(docs, ["source"], "doc_id", "text")


@query(
    "corpus_text_extract",
    f"SELECT doc_id, {_trim('text')} AS text FROM documents WHERE doc_id % 10 <> 0 AND {_trim('text')} <> ''",
)
def corpus_text_extract(spark, sf_dir):
    docs = inputs.documents(spark, sf_dir, "doc_id", "text")
    padded = F.when(F.col("doc_id") % 10 == 0, F.lit(" \n ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n")))
    return op.corpus_text(docs.withColumn("story", padded), "story", "doc_id")


@query("first_n_rows", "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 100")
def first_n_rows(spark, sf_dir):
    return op.first_rows(inputs.table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id", 100)


@query(
    "preview_lines",
    """SELECT doc_id, array_to_string(string_split(text, chr(10))[1:30], chr(10)) AS preview, len(string_split(text, chr(10)))::BIGINT AS total_lines,
      least(30, len(string_split(text, chr(10))))::BIGINT AS shown_lines FROM documents""",
)
def preview_lines(spark, sf_dir):
    return op.preview(inputs.documents(spark, sf_dir, "doc_id", "text"), "text", "doc_id")


@query(
    "sample_truncate",
    f"""WITH {PAIRS_SQL}, lines AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6
        WHEN 0 THEN to_json({{'instruction': user_text, 'input': '', 'output': assistant_text}})::VARCHAR
        WHEN 1 THEN to_json({{'system_prompt': 'You are helper ' || (conv_id % 3), 'question': user_text, 'response': assistant_text}})::VARCHAR
        WHEN 2 THEN to_json({{'prompt': user_text, 'completion': assistant_text}})::VARCHAR
        WHEN 3 THEN to_json({{'query': user_text, 'answer': assistant_text}})::VARCHAR
        WHEN 4 THEN to_json({{'conversations': [{{'from': 'human', 'value': user_text}}, {{'from': 'gpt', 'value': assistant_text}}]}})::VARCHAR
        ELSE to_json({{'title': user_text, 'body': assistant_text}})::VARCHAR END AS line FROM pairs)
    SELECT conv_id, turn, CASE WHEN length(line) > 500 THEN substr(line, 1, 500) || '...' ELSE line END AS sample,
      ['input,instruction,output', 'question,response,system_prompt', 'completion,prompt', 'answer,query', 'conversations', 'body,title'][(conv_id + turn) % 6 + 1] AS columns
    FROM lines""",
)
def sample_truncate(spark, sf_dir):
    parsed = convert.parse_records(inputs.foreign_rows(spark, sf_dir), "line")
    return parsed.select("conv_id", "turn", *op.record_sample(F.col("line"), F.col("keys")))


_FACETS = {
    "brand": {"vendor": "Brand#7"},
    "small": {"size": "3"},
    "medium open": {"size": "14", "access": "open"},
    "large gated": {"size": "72", "access": "gated"},
    "search": {"search": "RED"},
    "all": {"vendor": "Brand#11", "size": "72", "access": "open", "search": "bolt"},
}


@query(
    "facet_filter",
    """WITH p AS (SELECT *, p_retailprice > 1000 AS gated FROM part)
    SELECT 'brand' AS facet, p_partkey FROM p WHERE p_brand = 'Brand#7' UNION ALL
    SELECT 'small', p_partkey FROM p WHERE p_size <= 3 UNION ALL
    SELECT 'medium open', p_partkey FROM p WHERE p_size <= 14 AND NOT gated UNION ALL
    SELECT 'large gated', p_partkey FROM p WHERE p_size > 14 AND gated UNION ALL
    SELECT 'search', p_partkey FROM p WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') UNION ALL
    SELECT 'all', p_partkey FROM p WHERE p_brand = 'Brand#11' AND p_size > 14 AND NOT gated AND (contains(lower(p_name), 'bolt') OR contains(lower(p_type), 'bolt'))""",
)
def facet_filter(spark, sf_dir):
    catalog = inputs.table(spark, sf_dir, "part").withColumn("gated", F.col("p_retailprice") > 1000)
    columns = {"vendor": "p_brand", "params": "p_size", "name": "p_name", "id": "p_type"}
    result = None
    for name, facets in _FACETS.items():
        part = op.facet_filter(catalog, columns=columns, **facets).select(F.lit(name).alias("facet"), "p_partkey")
        result = part if result is None else result.unionByName(part)
    return result


@query(
    "valid_conversations",
    "SELECT conv_id, count(*) AS turns FROM conversations WHERE role = 'assistant' GROUP BY conv_id HAVING count(*) >= 2",
)
def valid_conversations(spark, sf_dir):
    answers = inputs.conversations(spark, sf_dir).where("role = 'assistant'")
    nested = convert.nest_turns(answers, "conv_id", "turn", "role", "text")
    return op.valid_conversations(nested, "conv").select("conv_id", F.size("conv").cast("bigint").alias("turns"))


_PARTS_SQL = """parts AS (SELECT source AS dataset, doc_id AS ord, n_chars AS size, 'part-' || doc_id || '.parquet' AS filename,
    CASE WHEN substr(source, 4)::INT % 3 = 0 AND doc_id % 2 = 0 THEN 'default' ELSE lang END AS config,
    CASE substr(source, 4)::INT % 4 WHEN 0 THEN CASE WHEN doc_id % 5 < 2 THEN 'test' ELSE 'train' END WHEN 1 THEN CASE WHEN doc_id % 5 < 2 THEN 'test' ELSE 'all' END
      WHEN 2 THEN CASE WHEN doc_id % 5 < 2 THEN 'validation' ELSE 'test' END ELSE 'train' END AS split FROM documents)"""


@query(
    "manifest_split_select",
    f"""WITH {_PARTS_SQL}, c AS (SELECT dataset, config, row_number() OVER (PARTITION BY dataset ORDER BY (config <> 'default'), min(ord)) AS r FROM parts GROUP BY dataset, config),
    s AS (SELECT dataset, config, split, row_number() OVER (PARTITION BY dataset, config ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'all' THEN 1 ELSE 2 END, min(ord)) AS r FROM parts GROUP BY dataset, config, split)
    SELECT p.* FROM parts p JOIN c ON c.dataset = p.dataset AND c.config = p.config AND c.r = 1 JOIN s ON s.dataset = p.dataset AND s.config = p.config AND s.split = p.split AND s.r = 1""",
)
def manifest_split_select(spark, sf_dir):
    number = F.substring("source", 4, 9).cast("int")
    few = F.col("doc_id") % 5 < 2
    parts = inputs.table(spark, sf_dir, "documents").select(
        F.col("source").alias("dataset"),
        F.col("doc_id").alias("ord"),
        F.col("n_chars").alias("size"),
        F.concat(F.lit("part-"), F.col("doc_id").cast("string"), F.lit(".parquet")).alias("filename"),
        F.when((number % 3 == 0) & (F.col("doc_id") % 2 == 0), "default").otherwise(F.col("lang")).alias("config"),
        F.when(number % 4 == 0, F.when(few, "test").otherwise("train"))
        .when(number % 4 == 1, F.when(few, "test").otherwise("all"))
        .when(number % 4 == 2, F.when(few, "validation").otherwise("test"))
        .otherwise("train")
        .alias("split"),
    )
    return manifest.select_split(parts)


@query(
    "multi_source_union",
    """SELECT 0 AS file_ord, doc_id AS rec_ord, text, lang, NULL AS role FROM documents UNION ALL
    SELECT 1, conv_id * 100 + turn, text, NULL, role FROM conversations UNION ALL SELECT 2, item_id, text, NULL, NULL FROM benchmark""",
)
def multi_source_union(spark, sf_dir):
    docs = inputs.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    turns = inputs.conversations(spark, sf_dir).select((F.col("conv_id") * 100 + F.col("turn")).alias("turn_id"), "text", "role")
    items = inputs.table(spark, sf_dir, "benchmark").select("item_id", "text")
    stream = files.concat_sources([(docs, "doc_id"), (turns, "turn_id"), (items, "item_id")])
    return stream.select("file_ord", "rec_ord", "text", "lang", "role")
