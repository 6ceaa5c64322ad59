"""The query catalogue: one callable per operator of the inventory.

Every query reads the driver tables under ``sf_dir`` (or data Spark derives
from them) in full, so its work grows with the tables. Computed columns carry
the same aliases as the SQL in ``tessera.plans.oracle``."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.decode import decode_text
from tessera.operators import chunk as ch
from tessera.operators import chunk_blocks as cbl
from tessera.operators import combine as cb
from tessera.operators import embed as em
from tessera.operators import formats as fm
from tessera.operators import generate as gn
from tessera.operators import journal as jn
from tessera.operators import pages as pg
from tessera.operators import rows as rw
from tessera.operators import search as se
from tessera.operators import search_pruned as sp
from tessera.operators import stats as stt
from tessera.plans.parallel import spread
from tessera.plans.standins import load, pages_from_documents, qa_pairs_from_conversations
from tessera.session import scratch_path
from tessera.sources import quarantine as qr
from tessera.sources import readers as rd
from tessera.sources import sinks as sk
from tessera.sources.sinks import materialize
from tessera.sources.split_csv import read_csv_split
from tessera.streaming import incremental as inc
from tessera.streaming.incremental import resume_anti

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def documents(spark, sf_dir, spread_rows: bool = False) -> DataFrame:
    df = load(spark, sf_dir, "documents")
    return spread(df, "doc_id") if spread_rows else df


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A frame used twice is computed once: written to the shared scratch folder."""
    return materialize(df, scratch_path(df.sparkSession, name))


# ---------------------------------------------------------------- chunking
def chunk_stats_frame(chunks: DataFrame, by: list[str]) -> DataFrame:
    n = F.length("chunk")
    return chunks.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_chunks"), F.round(F.avg(n), 6).alias("avg_chunk_chars"),
        F.min(n).alias("min_chunk_chars"), F.max(n).alias("max_chunk_chars"))


@query("chunk_stats")
def q_chunk_stats(spark, sf_dir):
    """Flagship: documents -> valid text -> overlapping chunks -> stats by source."""
    docs = rw.filter_valid_text(documents(spark, sf_dir, True).select("doc_id", "source", "text"))
    return chunk_stats_frame(ch.chunk_text(docs, keep=["doc_id", "source"]), ["source"])


@query("chunk_text")
def q_chunk_text(spark, sf_dir):
    return ch.chunk_text(documents(spark, sf_dir, True).select("doc_id", "text"))


@query("chunk_blocks")
def q_chunk_blocks(spark, sf_dir):
    """The chunks of chunk_text, each text in blocks of 32,768 characters."""
    return cbl.chunk_text_blocks(documents(spark, sf_dir).select("doc_id", "text"), block_chars=1 << 15)


@query("chunk_small")
def q_chunk_small(spark, sf_dir):
    return ch.chunk_text(documents(spark, sf_dir, True).select("doc_id", "text"), size=300, overlap=50)


@query("chunk_overlap_ge_size")
def q_chunk_overlap_ge_size(spark, sf_dir):
    # one-character steps: the linear Arrow-batched walk (the default)
    return ch.chunk_text(documents(spark, sf_dir, True).select("doc_id", "text"), size=50, overlap=60)


@query("chunk_sentences")
def q_chunk_sentences(spark, sf_dir):
    return ch.chunk_by_sentences(documents(spark, sf_dir, True).select("doc_id", "text"), k=5)


@query("split_sentences")
def q_split_sentences(spark, sf_dir):
    return ch.explode_sentences(documents(spark, sf_dir, True).select("doc_id", "text"))


@query("paragraphs")
def q_paragraphs(spark, sf_dir):
    docs = documents(spark, sf_dir, True).select("doc_id", tx.clean_txt("text").alias("text"))
    return ch.explode_paragraphs(docs)


# ---------------------------------------------------------------- scalar text
@query("ws_trim")
def q_ws_trim(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", tx.ws_trim("text").alias("text"))


@query("ws_collapse")
def q_ws_collapse(spark, sf_dir):
    return documents(spark, sf_dir, True).select("doc_id", tx.ws_collapse("text").alias("text"))


@query("chunk_clean")
def q_chunk_clean(spark, sf_dir):
    return documents(spark, sf_dir, True).select("doc_id", tx.chunk_clean("text").alias("text"))


@query("sentence_boundary")
def q_sentence_boundary(spark, sf_dir):
    return documents(spark, sf_dir, True).select(
        "doc_id", tx.sentence_boundary(tx.chunk_clean("text"), F.lit(0)).alias("boundary"))


@query("clean_txt")
def q_clean_txt(spark, sf_dir):
    return documents(spark, sf_dir, True).select("doc_id", tx.clean_txt("text").alias("text"))


# ---------------------------------------------------------------- rows
@query("row_index")
def q_row_index(spark, sf_dir):
    return rw.with_row_index(documents(spark, sf_dir), bare_scan=True).select("doc_id", "real_index")


@query("slice_rows")
def q_slice_rows(spark, sf_dir):
    # resume from index 100; max_samples = 0 means "all the rest"
    df = rw.with_row_index(documents(spark, sf_dir), bare_scan=True)
    return rw.slice_rows(df, start=100, max_samples=0).select("real_index", "doc_id")


@query("valid_text")
def q_valid_text(spark, sf_dir):
    return rw.filter_valid_text(documents(spark, sf_dir)).select("doc_id", "text")


@query("min_length")
def q_min_length(spark, sf_dir):
    return rw.filter_min_length(rw.filter_valid_text(documents(spark, sf_dir))).select(
        "doc_id", F.length(tx.ws_collapse("text")).alias("n"))


@query("dataset_chunks")
def q_dataset_chunks(spark, sf_dir):
    return rw.dataset_chunks(spread(rw.with_row_index(documents(spark, sf_dir), bare_scan=True), "real_index"))


# ---------------------------------------------------------------- pages
def _pages(spark, sf_dir):
    return pages_from_documents(documents(spark, sf_dir, True))


@query("page_limit")
def q_page_limit(spark, sf_dir):
    return pg.page_limit(_pages(spark, sf_dir), 3).select("doc_id", "page_num", "text")


@query("pages_drop_blank")
def q_pages_drop_blank(spark, sf_dir):
    return pg.pages_drop_blank(_pages(spark, sf_dir)).select("doc_id", "page_num", "text")


@query("pages_keep_blank")
def q_pages_keep_blank(spark, sf_dir):
    return pg.pages_keep_blank(_pages(spark, sf_dir)).select("doc_id", "page_num", "text")


@query("clean_page")
def q_clean_page(spark, sf_dir):
    return pg.clean_pages(_pages(spark, sf_dir)).select("doc_id", "page_num", "text")


@query("join_pages")
def q_join_pages(spark, sf_dir):
    return pg.join_pages(_pages(spark, sf_dir), ["doc_id"])


@query("page_stats")
def q_page_stats(spark, sf_dir):
    st = pg.page_stats(_pages(spark, sf_dir), ["doc_id"])
    return st.withColumn("avg_chars_per_page", F.round("avg_chars_per_page", 6))


# ---------------------------------------------------------------- sources
def _doc_cols(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source",
                     F.col("n_chars").cast("long").alias("n_chars"))


@query("scan_parquet")
def q_scan_parquet(spark, sf_dir):
    return _doc_cols(rd.read_table(spark, f"{sf_dir.rstrip('/')}/documents.parquet"))


@query("scan_csv")
def q_scan_csv(spark, sf_dir):
    path = scratch_path(spark, "documents-csv") + "/documents.csv"
    (documents(spark, sf_dir).write.mode("overwrite")
     .csv(path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
          ignoreTrailingWhiteSpace=False))
    return _doc_cols(rd.read_table(spark, path))


@query("scan_csv_split")
def q_scan_csv_split(spark, sf_dir):
    path = scratch_path(spark, "documents-csv") + "/documents.csv"
    (documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit(" "), F.lit("\n"))).write.mode("overwrite")
     .csv(path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False,
          ignoreTrailingWhiteSpace=False))
    return _doc_cols(read_csv_split(spark, path, "doc_id long, text string, lang string, source string, n_chars long"))


@query("scan_json")
def q_scan_json(spark, sf_dir):
    path = scratch_path(spark, "documents-json") + "/documents.jsonl"
    documents(spark, sf_dir).write.mode("overwrite").json(path, ignoreNullFields=False)
    return _doc_cols(rd.read_table(spark, path))


FOLDERS = 64  # that files of documents are dealt over: they are made and listed side by side


def _dealt(name: F.Column) -> F.Column:
    """A file name of a document, in one of ``FOLDERS`` folders."""
    return F.concat(F.format_string("%02d/", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDERS))), name).alias("file_name")


def _write_txt_files(spark, sf_dir) -> str:
    """Each document as its own UTF-8 .txt file ``<folder>/doc_<id>.txt`` in the shared scratch folder."""
    path = scratch_path(spark, "documents-txt")
    files = documents(spark, sf_dir, True).select(_dealt(F.format_string("doc_%d.txt", "doc_id")),
                                                  F.col("text").alias("body"))
    sk.write_files(files, path)
    return path


def _doc_id_from_path() -> F.Column:
    return F.regexp_extract("path", r"doc_(\d+)\.txt$", 1).cast("long").alias("doc_id")


@query("scan_txt")
def q_scan_txt(spark, sf_dir):
    files = rd.read_text_files(spark, _write_txt_files(spark, sf_dir))
    return files.select(_doc_id_from_path(), "text")


@query("decode_txt")
def q_decode_txt(spark, sf_dir):
    files = rd.read_binary_files(spark, _write_txt_files(spark, sf_dir), "*.txt")
    return files.select(_doc_id_from_path(), decode_text("content").alias("text"))


@query("scan_named_split")
def q_scan_named_split(spark, sf_dir):
    path = scratch_path(spark, "documents-by-lang")
    documents(spark, sf_dir).write.mode("overwrite").partitionBy("lang").parquet(path)
    return _doc_cols(rd.read_named(spark, path, split="en", split_col="lang"))


@query("dataset_info")
def q_dataset_info(spark, sf_dir):
    docs = documents(spark, sf_dir)
    info = rd.dataset_info(docs, "documents", split="train", text_col="text", order_col="doc_id")
    feats = F.array_join(F.transform(F.map_entries("features"),
                                     lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return info.select(
        "name", "split", "config", "total_samples", F.array_join("columns", ",").alias("columns"),
        feats.alias("features"), "text_column_exists",
        *[F.col("sample_data")[c].alias(f"sample_{c}") for c in docs.columns])


# ---------------------------------------------------------------- QA and formats
def _qa(spark, sf_dir, with_types: bool = False) -> DataFrame:
    conv = load(spark, sf_dir, "conversations")
    labels = load(spark, sf_dir, "labels") if with_types else None
    return qa_pairs_from_conversations(conv, labels)


def _table_chunks(spark, sf_dir) -> DataFrame:
    """The table path: documents with row position -> dataset chunks."""
    return rw.dataset_chunks(spread(rw.with_row_index(documents(spark, sf_dir), bare_scan=True), "real_index"))


def _doc_chunks(spark, sf_dir) -> DataFrame:
    return ch.chunk_text(documents(spark, sf_dir, True).select("doc_id", "text"))


@query("question_fanout")
def q_question_fanout(spark, sf_dir):
    return gn.question_fanout(_doc_chunks(spark, sf_dir), 3).select("doc_id", "chunk_index", "question_index")


@query("qa_ids")
def q_qa_ids(spark, sf_dir):
    fan = gn.question_fanout(_table_chunks(spark, sf_dir), 3)
    return fan.select("real_index", "question_index", tx.qa_id("real_index", "question_index").alias("id"))


@query("output_names")
def q_output_names(spark, sf_dir):
    fan = gn.question_fanout(_table_chunks(spark, sf_dir), 3)
    return fan.select("real_index", "question_index",
                      F.format_string(tx.TABLE_CHUNK_FILE_FORMAT, "real_index").alias("chunk_file"),
                      F.format_string(tx.TABLE_CHUNK_QA_FILE_FORMAT, "real_index", "question_index").alias("qa_file"),
                      F.format_string(tx.DATASET_CHUNK_FILE_FORMAT, "real_index").alias("named_chunk_file"),
                      F.format_string(tx.CHUNK_QA_FILE_FORMAT, "real_index", "question_index").alias("doc_qa_file"))


@query("question_prompt")
def q_question_prompt(spark, sf_dir):
    return _table_chunks(spark, sf_dir).select("real_index", gn.question_prompt("chunk").alias("prompt"))


@query("answer_prompt")
def q_answer_prompt(spark, sf_dir):
    return _qa(spark, sf_dir).select("id", gn.answer_prompt("context", "question").alias("prompt"))


@query("generate_qa")
def q_generate_qa(spark, sf_dir):
    return gn.generate_qa(_table_chunks(spark, sf_dir), gn.FirstSentenceGenerator, n_questions=3)


@query("join_chunk_qa")
def q_join_chunk_qa(spark, sf_dir):
    chunks = _stored(_doc_chunks(spark, sf_dir), "chunks")
    fan = gn.question_fanout(chunks.select("doc_id", "chunk_index"), 3)
    return (chunks.join(fan, ["doc_id", "chunk_index"])
            .select("doc_id", "chunk_index", "question_index", F.length("chunk").alias("chunk_chars")))


@query("resume_anti")
def q_resume_anti(spark, sf_dir):
    done = load(spark, sf_dir, "labels").select("doc_id")
    return resume_anti(documents(spark, sf_dir).select("doc_id", "source"), done, ["doc_id"])


def _by_folder(spark, files, fmt):
    """Text parts of a .jsonl folder are JSON lines, whatever Spark names them."""
    return qr.read_lenient(spark, files, "json" if ".jsonl/" in files[0] else fmt)


class OddLengthsFail(gn.FirstSentenceGenerator):
    """The stand-in model on a bad day: contexts of odd length fail."""

    def generate(self, prompts, **options):
        if any(len(p.split(gn.TEXT_MARKER, 1)[1].split(gn.QUESTION_MARKER)[0]) % 2 for p in prompts):
            raise RuntimeError("odd length")
        return super().generate(prompts, **options)


@query("generate_resume")
def q_generate_resume(spark, sf_dir):
    """A run that fails on some rows and its successor: run tells who answered."""
    chunks, path = _stored(_table_chunks(spark, sf_dir), "resume-chunks"), scratch_path(spark, "journal")
    jn.generate_journalled(chunks, OddLengthsFail, path, ["real_index"], n_questions=3)
    return jn.generate_journalled(chunks, gn.FirstSentenceGenerator, path, ["real_index"], n_questions=3, with_run=True)


@query("union_sources")
def q_union_sources(spark, sf_dir):
    docs = documents(spark, sf_dir).select(F.lit("documents").alias("src"), "doc_id", "text")
    bench = load(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("src"),
                                                     F.col("item_id").alias("doc_id"), "text")
    return cb.union_sources([docs, bench])


@query("union_with_errors")
def q_union_with_errors(spark, sf_dir):
    """All documents from three files of different columns and types, one of them with a malformed
    line for every document, and a file that is no Parquet: the good rows, and what was put aside."""
    root = scratch_path(spark, "union-errors")
    docs = documents(spark, sf_dir).select("doc_id", "text", "n_chars")
    third = F.pmod(F.col("doc_id"), F.lit(3))
    line = F.to_json(F.struct("doc_id", "text"))
    lines = docs.filter(third == 0).select(line.alias("value")).union(docs.select(F.concat(F.lit('{"doc_id": '), "doc_id", F.lit(', "text": '))))
    lines.write.text(f"{root}/some.jsonl")
    docs.filter(third == 1).select("doc_id", "text", F.col("n_chars").cast("double").alias("n_chars")).write.parquet(f"{root}/wide.parquet")
    docs.filter(third == 2).select(F.col("n_chars").cast("int").alias("n_chars"), "text", "doc_id").write.parquet(f"{root}/other.parquet")
    docs.select(F.to_json(F.struct("text")).alias("value")).write.text(f"{root}/no.parquet")
    inputs = [f"{root}/some.jsonl/*.txt", f"{root}/wide.parquet", f"{root}/no.parquet/*.txt", f"{root}/other.parquet"]
    good, wrong = qr.read_quarantined(spark, inputs[:2] + inputs[3:], f"{root}/read", ["text"], "auto", _by_folder)
    none, broken = qr.read_quarantined(spark, inputs[2:3], f"{root}/broken", ["text"], "parquet")
    rows = good.unionByName(none, allowMissingColumns=True).select(F.lit("row").alias("kind"), "doc_id", "text", "n_chars")
    aside = wrong.unionByName(broken.select("path", "kind", "record", "error").dropDuplicates(["kind"]))
    return rows.unionByName(aside.select("kind", F.regexp_extract("record", r"(\d+)", 1).cast("long").alias("doc_id"),
                                         F.col("record").alias("text"), F.lit(None).cast("double").alias("n_chars")))


@query("union_missing_cols")
def q_union_missing_cols(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    bench = load(spark, sf_dir, "benchmark").select("item_id", "text")
    return cb.union_missing_cols([docs, bench])


@query("qa_stats")
def q_qa_stats(spark, sf_dir):
    s = stt.qa_stats(_qa(spark, sf_dir))
    return s.select("total_pairs", *[F.round(c, 6).alias(c) for c in s.columns[1:]])


@query("question_type_counts")
def q_question_type_counts(spark, sf_dir):
    return stt.question_type_counts(_qa(spark, sf_dir, with_types=True))


@query("metadata")
def q_metadata(spark, sf_dir):
    m = stt.metadata(_qa(spark, sf_dir, with_types=True), "conversations.parquet")
    types = F.array_join(F.transform(F.array_sort(F.map_entries("statistics.question_types")),
                                     lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return m.select(F.col("dataset_info.name").alias("name"), F.col("dataset_info.description").alias("description"),
                    F.col("dataset_info.source_file").alias("source_file"),
                    F.col("dataset_info.total_qa_pairs").alias("total_qa_pairs"), types.alias("question_types"),
                    F.round("statistics.avg_question_length", 6).alias("avg_question_length"),
                    F.round("statistics.avg_answer_length", 6).alias("avg_answer_length"))


@query("fmt_instruction_id")
def q_fmt_instruction_id(spark, sf_dir):
    return fm.to_instruction_with_id(_qa(spark, sf_dir))


@query("fmt_instruction")
def q_fmt_instruction(spark, sf_dir):
    return fm.to_instruction(_qa(spark, sf_dir))


@query("fmt_alpaca")
def q_fmt_alpaca(spark, sf_dir):
    return fm.to_alpaca(_qa(spark, sf_dir))


@query("fmt_chat")
def q_fmt_chat(spark, sf_dir):
    chat = fm.to_chat(_qa(spark, sf_dir), keep=["id"])
    return chat.select("id", F.to_json("messages").alias("messages"))


@query("datapoint_json")
def q_datapoint_json(spark, sf_dir):
    return fm.alpaca_datapoint_files(_qa(spark, sf_dir))


@query("qa_pair_json")
def q_qa_pair_json(spark, sf_dir):
    return fm.chunk_qa_files(_qa(spark, sf_dir), tx.TABLE_CHUNK_QA_FILE_FORMAT)


@query("chunk_stats_global")
def q_chunk_stats_global(spark, sf_dir):
    s = stt.chunk_stats(_doc_chunks(spark, sf_dir))
    return s.withColumn("avg_chunk_chars", F.round("avg_chunk_chars", 6))


@query("dataset_chunk_stats")
def q_dataset_chunk_stats(spark, sf_dir):
    s = stt.dataset_chunk_stats(_table_chunks(spark, sf_dir))
    return s.withColumn("avg_chunk_chars", F.round("avg_chunk_chars", 6))


@query("run_summary")
def q_run_summary(spark, sf_dir):
    chunks = _stored(_doc_chunks(spark, sf_dir).select("doc_id", "chunk_index"), "chunks")
    qa = gn.question_fanout(chunks, 3)
    s = stt.run_summary(chunks, qa, load(spark, sf_dir, "embeddings"))
    return s.withColumn("qa_per_chunk", F.round("qa_per_chunk", 6))


# ---------------------------------------------------------------- vectors
def _vectors(spark, sf_dir) -> DataFrame:
    return load(spark, sf_dir, "embeddings")


@query("embed_hashing")
def q_embed_hashing(spark, sf_dir):
    vec = em.embed(_doc_chunks(spark, sf_dir), lambda: em.HashingEncoder(64), text_col="chunk")
    return (vec.select("doc_id", "chunk_index", F.posexplode("embedding").alias("dim", "value"))
            .filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double")))


@query("embed_token_budget")
def q_embed_token_budget(spark, sf_dir):
    vec = em.embed(_doc_chunks(spark, sf_dir), lambda: em.HashingEncoder(64), text_col="chunk", token_budget=4096)
    return (vec.select("doc_id", "chunk_index", F.posexplode("embedding").alias("dim", "value"))
            .filter(F.col("value") != 0).withColumn("value", F.col("value").cast("double")))


@query("mean_pool")
def q_mean_pool(spark, sf_dir):
    tokens = _vectors(spark, sf_dir).select(
        F.col("label").alias("key"), "embedding",
        F.when(F.col("embedding")[0] >= 0, 1).otherwise(0).alias("mask"))
    pooled = em.mean_pool(tokens)
    return pooled.select("key", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round("value", 6))


@query("embedding_dim")
def q_embedding_dim(spark, sf_dir):
    return em.embedding_dim(_vectors(spark, sf_dir))


@query("cosine")
def q_cosine(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next_id"),
                   F.col("embedding").alias("next_embedding"))
    return v.join(nxt, "vec_id").select("vec_id", "next_id",
                                        F.round(se.cosine("embedding", "next_embedding"), 6).alias("score"))


@query("topk_single")
def q_topk_single(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return se.top_k_single(v, se.centroid(v), k=5).withColumn("score", F.round("score", 6))


@query("topk_batch")
def q_topk_batch(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return se.top_k(v, v, k=5).withColumn("score", F.round("score", 6))


@query("topk_pruned")
def q_topk_pruned(spark, sf_dir):
    """The result of topk_batch by blocks around pivots."""
    v = _vectors(spark, sf_dir)
    return sp.top_k_pruned(v, v, k=5, block_rows=256)[0].withColumn("score", F.round("score", 6))


@query("page_chunks")
def q_page_chunks(spark, sf_dir):
    """Document path with pages: non-blank pages joined with their banners,
    then chunked (the banners' '=' signs are cleaned away, 'PAGE n' stays)."""
    joined = pg.join_pages(_pages(spark, sf_dir), ["doc_id"])
    return ch.chunk_text(joined, keep=["doc_id"])


@query("chunk_files")
def q_chunk_files(spark, sf_dir):
    """One text file per chunk (name and body), in one folder per document."""
    chunks = _doc_chunks(spark, sf_dir).withColumn("path", F.format_string("doc_%d.txt", "doc_id"))
    return fm.chunk_files(chunks, tx.CHUNK_FILE_FORMAT, prefix_col="path")


@query("qa_pair_files")
def q_qa_pair_files(spark, sf_dir):
    """One pretty JSON file per QA pair, numbered densely in QA order."""
    return fm.qa_pair_files(_qa(spark, sf_dir))


# ---------------------------------------------------------------- row positions over several files
def _in_files(spark, sf_dir, fmt: str) -> str:
    """documents as several files whose path order is the order of doc_id."""
    path = scratch_path(spark, f"documents-{fmt}")
    docs = documents(spark, sf_dir).repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id")
    docs.write.format(fmt).save(path)
    return path


@query("row_index_multi_file")
def q_row_index_multi_file(spark, sf_dir):
    return rw.with_row_index(spark.read.parquet(_in_files(spark, sf_dir, "parquet"))).select("doc_id", "real_index")


@query("row_index_json")
def q_row_index_json(spark, sf_dir):
    return rw.with_row_index(rd.read_table(spark, _in_files(spark, sf_dir, "json"), "json")).select("doc_id", "real_index")


@query("slice_after_split")
def q_slice_after_split(spark, sf_dir):
    """Positions count the rows of the chosen split only."""
    df = rd.read_named(spark, _in_files(spark, sf_dir, "parquet"), split="en", split_col="lang")
    return rw.slice_rows(rw.with_row_index(df), start=20).select("real_index", "doc_id")


@query("scan_auto_formats")
def q_scan_auto_formats(spark, sf_dir):
    """The same table under each suffix, its format found from the path."""
    root, docs = scratch_path(spark, "formats"), documents(spark, sf_dir)
    frames = []
    for suffix in ("csv", "JSONL", "json", "parquet", "unknown"):
        path = f"{root}/documents.{suffix}"
        w = docs.write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
        w.format(rd.detect_format(path)).option("header", True).save(path)
        frames.append(rd.read_table(spark, path).select(F.lit(suffix).alias("suffix"), "text"))
    return cb.union_sources(frames).groupBy("suffix").agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("chars"))


# ---------------------------------------------------------------- document sources
def _form_feeds(spark, sf_dir) -> DataFrame:
    """documents as text layers: a page per line, form feeds between them."""
    return documents(spark, sf_dir, True).select("doc_id", F.translate("text", "\n", "\f").alias("text"))


@query("pages_text_layer")
def q_pages_text_layer(spark, sf_dir):
    return pg.pages_from_text_layer(_form_feeds(spark, sf_dir), ["doc_id"])


def _mixed_files(spark, sf_dir) -> str:
    """One file a document: .pdf, .PDF, .txt or .md by doc_id."""
    path = scratch_path(spark, "documents-mixed")
    suffix = F.element_at(F.array(*map(F.lit, ("pdf", "PDF", "txt", "md"))), (F.col("doc_id") % 4 + 1).cast("int"))
    files = _form_feeds(spark, sf_dir).select(_dealt(F.concat(F.format_string("doc_%d.", "doc_id"), suffix)), F.col("text").alias("body"))
    sk.write_files(files, path)
    return path


def _form_feed_extractor():
    return lambda content: content.decode("utf-8").split("\f")


def _file_id():
    return F.regexp_extract("path", r"doc_(\d+)\.[A-Za-z]+$", 1).cast("long").alias("doc_id")


@query("pdf_pages")
def q_pdf_pages(spark, sf_dir):
    pages = rd.read_pdf_pages(spark, _mixed_files(spark, sf_dir), _form_feed_extractor)
    return pages.select(_file_id(), "page_num", "text")


@query("pdf_pages_all")
def q_pdf_pages_all(spark, sf_dir):
    """Every document as a .pdf or .PDF file, in a folder of its own."""
    path = scratch_path(spark, "documents-pdf")
    suffix = F.when(F.col("doc_id") % 2 == 0, "pdf").otherwise("PDF")
    sk.write_files(_form_feeds(spark, sf_dir).select(_dealt(F.concat(F.format_string("doc_%d.", "doc_id"), suffix)), F.col("text").alias("body")), path)
    return rd.read_pdf_pages(spark, path, _form_feed_extractor).select(_file_id(), "page_num", "text")


@query("split_by_extension")
def q_split_by_extension(spark, sf_dir):
    parts = rd.split_by_extension(rd.read_binary_files(spark, _mixed_files(spark, sf_dir)))
    return cb.union_sources([df.select(F.lit(kind).alias("kind"), _file_id()) for kind, df in parts.items()])


# ---------------------------------------------------------------- sinks, written and read back
@query("sink_json")
def q_sink_json(spark, sf_dir):
    qa = _qa(spark, sf_dir)
    return spark.read.schema(qa.schema).json(sk.write_json(qa, scratch_path(spark, "qa-json"))).select(qa.columns)


@query("sink_csv")
def q_sink_csv(spark, sf_dir):
    qa = _qa(spark, sf_dir)
    back = rd.read_table(spark, sk.write_csv(qa, scratch_path(spark, "qa") + ".csv"))
    return back.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in qa.schema))


@query("sink_embeddings")
def q_sink_embeddings(spark, sf_dir):
    path = sk.write_embeddings(_vectors(spark, sf_dir), scratch_path(spark, "vectors"), ["vec_id"])
    return spark.read.parquet(path).select("vec_id", F.posexplode("embedding").alias("dim", "value")).withColumn(
        "value", F.round(F.col("value").cast("double"), 6))


@query("export_all")
def q_export_all(spark, sf_dir):
    """Rows in every output of the multi-format export."""
    out = sk.export_qa(_qa(spark, sf_dir), scratch_path(spark, "export"), "run", "all", datapoint_files=True)
    frames = []
    for name, path in out.items():
        if name == "alpaca_datapoints":
            df = rd.read_binary_files(spark, path, "*.json").select("path")
        else:
            df = spark.read.parquet(path) if name == "qa_parquet" else rd.read_table(spark, path, "csv" if name.endswith("csv") else "json")
        frames.append(df.select(F.lit(name).alias("output")))
    return cb.union_sources(frames).groupBy("output").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_sink")
def q_metadata_sink(spark, sf_dir):
    path = sk.write_json(stt.metadata(_qa(spark, sf_dir), "conversations.parquet"), scratch_path(spark, "metadata"))
    m = spark.read.json(path)
    return m.select(F.col("dataset_info.source_file").alias("source_file"), F.col("dataset_info.total_qa_pairs").alias("total_qa_pairs"),
                    F.round("statistics.avg_question_length", 6).alias("avg_question_length"))


# ---------------------------------------------------------------- streams and progress
@query("stream_chunks")
def q_stream_chunks(spark, sf_dir):
    """Every text file chunked by the stream, read back from its output."""
    out = scratch_path(spark, "stream")
    inc.stream_text_files(spark, _write_txt_files(spark, sf_dir), f"{out}/chunks", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/chunks").select(_doc_id_from_path(), "chunk_index", "chunk_start", "chunk_end", "chunk")


@query("stream_qa_stats")
def q_stream_qa_stats(spark, sf_dir):
    """Running statistics over a stream of QA rows, as of its end."""
    out = scratch_path(spark, "stream-qa")
    qa = _qa(spark, sf_dir, with_types=True)
    qa.write.parquet(f"{out}/qa")
    stream = spark.readStream.schema(qa.schema).parquet(f"{out}/qa")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{out}/stats")

    (inc.running_qa_stats(stream).writeStream.outputMode("complete").foreachBatch(keep)
     .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination())
    s = spark.read.parquet(f"{out}/stats")
    return s.select("question_type", "n", *(F.round(c, 6).alias(c) for c in ("avg_question_length", "avg_answer_length")))


@query("progress")
def q_progress(spark, sf_dir):
    """Running totals observed while the documents are written."""
    observed, totals = inc.with_progress(documents(spark, sf_dir), "documents", "text")
    observed.write.parquet(scratch_path(spark, "observed"))
    got = totals.get
    return spark.range(1).select(F.lit(got["rows"]).cast("long").alias("rows"), F.lit(got["chars"]).cast("long").alias("chars"))


@query("unavailable_model")
def q_unavailable_model(spark, sf_dir):
    """Chunks and QA rows per question where no model can be loaded: no QA rows."""
    chunks = _table_chunks(spark, sf_dir)
    qa = gn.generate_qa(chunks, lambda: None, n_questions=3)
    counted = cb.union_sources([chunks.select(F.lit("chunks").alias("kind")), qa.select(F.lit("qa").alias("kind"))])
    return counted.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("local_question_prompt")
def q_local_question_prompt(spark, sf_dir):
    return _table_chunks(spark, sf_dir).select("real_index", gn.question_prompt("chunk", gn.QUESTION_TEMPLATE_LOCAL).alias("prompt"))
