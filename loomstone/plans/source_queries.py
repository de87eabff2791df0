"""Named queries of readers and writers: tables written to files and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract, packing, sft
from ..sources import files, shards, sinks
from . import inputs
from .registry import query
from .token_queries import CODEPOINTS, SEQ_LEN, SFT_LEN, _MASK_SQL, _STREAM_SQL, codepoint_blocks, codepoint_examples

_WS = "' ' || chr(9) || chr(10) || chr(13)"


def _by_source(spark, sf_dir, *columns):
    """Documents with each source in one partition and in order, so that each gives one file."""
    docs = inputs.table(spark, sf_dir, "documents").select("source", "doc_id", *columns)
    return docs.repartition("source").sortWithinPartitions("source", "doc_id")


def _array_lines(records):
    """Lines (source, value) of one JSON array a source, which begins with a 0: its records in order, and a line before and behind them."""
    ends = F.explode(F.array(F.struct(F.lit(0).alias("part"), F.lit("[0").alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]").alias("value"))))
    frame = records.select("source").distinct().select("source", ends.alias("end")).select("source", "end.part", F.lit(None).cast("bigint").alias("doc_id"), "end.value")
    lines = records.select("source", F.lit(1).alias("part"), "doc_id", F.concat(F.lit(","), "line").alias("value"))
    return lines.unionByName(frame).repartition("source").sortWithinPartitions("source", "part", "doc_id").select("source", "value")


def _folder_name(path):
    return F.regexp_extract(path, "source=([^/]+)/", 1)


@query(
    "line_source",
    """SELECT source, count(*) AS lines, sum(length(line))::BIGINT AS chars, sum(length(line) * line_no)::BIGINT AS weighted FROM (
      SELECT source, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS line_no FROM
        (SELECT source, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY source)) GROUP BY source""",
)
def line_source(spark, sf_dir):
    """Text files read as numbered lines, the empty line behind a closing newline included."""
    folder = inputs.scratch(spark, "lines")
    _by_source(spark, sf_dir, "text").select("source", "text").write.partitionBy("source").text(folder)
    lines = files.read_lines(spark, f"{folder}/*/*.txt", closing_line=True)
    size = F.length("line").cast("bigint")
    return lines.groupBy(_folder_name("source").alias("source")).agg(
        F.count("*").alias("lines"), F.sum(size).alias("chars"), F.sum(size * F.col("line_no")).alias("weighted")
    )


@query(
    "jsonl_roundtrip",
    "SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END AS lang FROM documents",
)
def jsonl_roundtrip(spark, sf_dir):
    """Records written as JSON lines and read back; nulls are kept as keys."""
    folder = inputs.scratch(spark, "jsonl")
    docs = inputs.documents(spark, sf_dir, "doc_id", "text", "lang")
    sinks.write_jsonl(docs.withColumn("lang", F.when(F.col("doc_id") % 3 != 0, F.col("lang"))), folder)
    return (
        files.read_jsonl(spark, f"{folder}/*.json")
        .where("array_contains(json_object_keys(line), 'lang')")
        .select(F.from_json("line", "doc_id bigint, text string, lang string").alias("r"))
        .select("r.*")
    )


def _delimited(spark, sf_dir, sep):
    folder = inputs.scratch(spark, "delimited")
    docs = inputs.documents(spark, sf_dir, "doc_id", "source", "text")
    docs.write.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"').csv(folder)
    return files.read_delimited(spark, folder, sep)


_DELIMITED_SQL = "SELECT doc_id::VARCHAR AS doc_id, source, text FROM documents"


@query("csv_source", _DELIMITED_SQL)
def csv_source(spark, sf_dir):
    return _delimited(spark, sf_dir, ",")


@query("tsv_source", _DELIMITED_SQL)
def tsv_source(spark, sf_dir):
    return _delimited(spark, sf_dir, "\t")


@query(
    "json_array_source",
    """SELECT conv_id, CASE WHEN conv_id % 3 = 2 THEN 1 ELSE row_number() OVER (PARTITION BY conv_id ORDER BY turn) END AS line_no, role, text
    FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations) WHERE conv_id % 3 <> 2 OR turn = first""",
)
def json_array_source(spark, sf_dir):
    """Conversations as JSON documents: an array, an array under ``data``, or a single object."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    docs = inputs.conversations(spark, sf_dir).groupBy("conv_id").agg(turns.alias("turns"))
    kind = F.col("conv_id") % 3
    doc = (
        F.when(kind == 0, F.to_json("turns"))
        .when(kind == 1, F.to_json(F.struct(F.col("turns").alias("data"), F.lit("x").alias("name"))))
        .otherwise(F.to_json(F.col("turns")[0]))
    )
    objects = files.json_documents(docs.select("conv_id", doc.alias("doc")), "conv_id", "doc")
    record = F.from_json("line", "role string, text string")
    return objects.select("conv_id", "line_no", record["role"].alias("role"), record["text"].alias("text"))


def _rows_sql(extension: str, rows: str) -> str:
    return f"SELECT source, '{extension}' AS ext, {rows} AS n FROM documents GROUP BY source"


@query(
    "row_counts_by_reader",
    f"""{_rows_sql('csv', 'count(*)')} UNION ALL {_rows_sql('tsv', 'count(*)')} UNION ALL {_rows_sql('json', 'count(*) + 1')}
    UNION ALL {_rows_sql('jsonl', "count(*) FILTER (doc_id % 5 <> 0)")} HAVING count(*) FILTER (doc_id % 5 <> 0) > 0 UNION ALL {_rows_sql('txt', "sum(len(string_split(text, chr(10))))::BIGINT")}""",
)
def row_counts_by_reader(spark, sf_dir):
    """Rows of files of each format as their readers count them; texts hold newlines and quotes.

    A source is one JSON array in one file, written record by record. The other formats may have several files a source, so each task writes its own rows as they are.
    """
    result = None
    rows = inputs.table(spark, sf_dir, "documents").select("source", "doc_id", "text")
    record = F.to_json(F.struct("doc_id", "text"))
    for ext in ("csv", "tsv", "json", "jsonl", "txt"):
        folder = inputs.scratch(spark, f"counted-{ext}")
        if ext in ("csv", "tsv"):
            sep = "," if ext == "csv" else "\t"
            rows.write.partitionBy("source").csv(folder, header=True, sep=sep, quote='"', escape='"')
        else:
            # One text a file; lines that are no object count in no reader of JSON lines.
            lines = {
                "json": _array_lines(rows.select("source", "doc_id", record.alias("line"))),
                "jsonl": rows.select("source", F.when(F.col("doc_id") % 5 == 0, "{cut").otherwise(record).alias("value")),
                "txt": rows.select("source", F.col("text").alias("value")),
            }
            lines[ext].write.partitionBy("source").text(folder)
        counts = {
            "csv": lambda f: files.blocks.count_delimited(spark, f, ","), "tsv": lambda f: files.blocks.count_delimited(spark, f, "\t"),
            "json": lambda f: files.blocks.count_json_arrays(spark, f)[0],
            "jsonl": lambda f: files.read_jsonl(spark, f).groupBy("source").agg(F.count("*").alias("n")),
            "txt": lambda f: files.read_lines(spark, f).groupBy("source").agg(F.count("*").alias("n")),
        }[ext](f"{folder}/*/*")
        counted = counts.groupBy(_folder_name("source").alias("source")).agg(F.sum("n").alias("n")).select("source", F.lit(ext).alias("ext"), "n")
        result = counted if result is None else result.unionByName(counted)
    return result


@query(
    "file_catalog",
    """SELECT job, CASE WHEN job = 'tokenizer' THEN 0 ELSE count(DISTINCT source) END AS files FROM documents, (VALUES ('all'), ('text'), ('sft'), ('tokenizer')) AS t(job) GROUP BY job""",
)
def file_catalog(spark, sf_dir):
    """Files of a folder and how many each job accepts by extension."""
    folder = inputs.scratch(spark, "catalog")
    _by_source(spark, sf_dir).write.partitionBy("source").json(folder)
    listed = files.list_files(spark, folder).where("size > 0")
    accepted = [(job, F.col("ext").isin(extensions)) for job, extensions in files.JOB_EXTENSIONS.items()]
    counts = listed.agg(F.count("*").alias("all"), *[F.count_if(rule).alias(job) for job, rule in accepted])
    return counts.unpivot([], counts.columns, "job", "files")


@query(
    "corpus_file",
    f"SELECT sum(length(trim(text, {_WS})) + 2)::BIGINT AS chars, count(*) AS records FROM documents WHERE trim(text, {_WS}) <> ''",
)
def corpus_file(spark, sf_dir):
    """The text corpus as written: every record with a blank line behind it."""
    folder = inputs.scratch(spark, "corpus")
    records = extract.corpus_text(inputs.documents(spark, sf_dir, "text"), "text")
    sinks.write_corpus(records, "text", folder)
    lines = files.read_lines(spark, f"{folder}/*.txt", closing_line=True)
    # Per file: its lines joined by newlines; all files end in a blank line.
    per_file = lines.groupBy("source").agg((F.sum(F.length("line") + 1) - 1).alias("chars"))
    written = records.agg(F.count("*").alias("records")).scalar()
    return per_file.agg(F.sum("chars").alias("chars")).withColumn("records", written)


def _hex_blocks(spark, blocks, columns, name):
    """Blocks written as binary shards, and the bytes of each as read back, in hex."""
    folder = inputs.scratch(spark, name)
    shards.write(blocks, folder, columns)
    return shards.read(spark, folder, raw=True).select("seq_id", *[F.lower(F.hex(c)).alias(c) for c in columns])


@query(
    "packed_export",
    f"""WITH {_STREAM_SQL} SELECT seq_id, array_to_string(list_transform(ids, lambda i: printf('%02x%02x%02x%02x', i & 255, (i >> 8) & 255, (i >> 16) & 255, (i >> 24) & 255)), '') AS tokens FROM whole""",
)
def packed_export(spark, sf_dir):
    """Blocks as little-endian 32-bit ids, byte for byte."""
    return _hex_blocks(spark, codepoint_blocks(spark, sf_dir), {"tokens": sinks.token_dtype(CODEPOINTS)}, "packed-export")


@query(
    "sft_export",
    f"""WITH {_MASK_SQL} SELECT row_number() OVER (ORDER BY conv_id) - 1 AS seq_id, regexp_replace(mask, '(.)', '0\\1', 'g') AS mask,
      array_to_string(list_transform(string_split(tokens, ' ')::INT[], lambda i: printf('%02x%02x%02x%02x', i & 255, (i >> 8) & 255, (i >> 16) & 255, (i >> 24) & 255)), '') AS tokens
    FROM fitted WHERE conv_id % 3 <> 1""",
)
def sft_export(spark, sf_dir):
    """Token and mask blocks of some of the conversations, byte for byte, numbered without holes."""
    examples = codepoint_examples(spark, sf_dir).where("conv_id % 3 <> 1")
    blocks = sft.number_blocks(sft.pad_and_truncate(examples, SFT_LEN), "conv_id")
    return _hex_blocks(spark, blocks, {"mask": "B", "tokens": "I"}, "sft-export")


@query(
    "processed_listing",
    f"""WITH t AS (SELECT 'benchmark' AS name, sum(length(text))::BIGINT + 2 * (count(*) - 1) AS n, count(*) AS r FROM benchmark UNION ALL
      SELECT 'conversations', sum(length(text))::BIGINT + 2 * (count(*) - 1), count(*) FROM conversations UNION ALL
      SELECT 'documents', sum(length(text))::BIGINT + 2 * (count(*) - 1), count(*) FROM documents)
    SELECT name, n AS total_tokens, n // {SEQ_LEN} AS n_sequences, r AS rows_extracted, 'I' AS dtype FROM t""",
)
def processed_listing(spark, sf_dir):
    """Three tables packed and written with their meta rows, then listed."""
    folder = inputs.scratch(spark, "processed")
    orders = {"benchmark": "item_id", "conversations": "conv_id * 100 + turn", "documents": "doc_id"}
    chars = F.length("text")
    for name, order in orders.items():
        rows = inputs.table(spark, sf_dir, name).select(F.expr(order).alias("ord"), "text")
        meta = packing.processing_meta(rows, chars, chars, SEQ_LEN, CODEPOINTS, between=(2, 2))
        sinks.write_packed(packing.pack_codepoints(rows, "ord", "text", SEQ_LEN), f"{folder}/{name}", meta)
    listed = sinks.read_processed_meta(spark, f"{folder}/*/meta")
    return listed.select("name", "total_tokens", "n_sequences", "rows_extracted", "dtype")


@query(
    "text_column_pick",
    f"""SELECT 'documents' AS origin, 'text' AS picked, trim(text, {_WS}) AS text FROM documents WHERE trim(text, {_WS}) <> '' UNION ALL
    SELECT 'customer', 'c_name', c_name FROM customer UNION ALL SELECT 'region', 'r_regionkey', r_regionkey::VARCHAR FROM region""",
)
def text_column_pick(spark, sf_dir):
    """The text column chosen for three tables: by name, by content, and for want of one the first."""
    result = None
    for name in ("documents", "customer", "region"):
        rows = inputs.table(spark, sf_dir, name)
        picked = extract.pick_text_column(rows)
        text = extract.corpus_text(rows, picked).select(F.lit(name).alias("origin"), F.lit(picked).alias("picked"), "text")
        result = text if result is None else result.unionByName(text)
    return result
