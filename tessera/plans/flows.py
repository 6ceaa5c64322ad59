"""End-to-end flows, the Spark form of the reference's three entry points:
documents (TXT/PDF files), a table of text from a file, a named dataset.

read -> clean -> chunk -> [materialise chunks] -> generate QA (plug-in) ->
[materialise QA] -> embed chunks (plug-in) -> export formats + statistics.

Materialisation points are Parquet tables under ``out_dir``: they cut the
lineage (a lost executor never replays model calls of finished stages) and
let every export read the same stored result."""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import chunk as ch
from tessera.operators import embed as em
from tessera.operators import formats as fm
from tessera.operators import generate as gn
from tessera.operators import journal as jn
from tessera.operators import pages as pg
from tessera.operators import rows as rw
from tessera.operators import stats as st
from tessera.plans.parallel import spread
from tessera.sources import readers as rd
from tessera.sources import quarantine as qr
from tessera.sources import sinks as sk
from tessera.streaming.incremental import with_progress


def _generated(spark: SparkSession, chunks: DataFrame, root: str, base: str, keys: list[str], keep: list[str], generator_factory,
               n_questions: int, index_col: str, preset: gn.Preset | None, model_partitions: int | None) -> DataFrame:
    """The stored QA rows of a run. Every answer is journalled by the task that asks; a run of the
    same name asks only for what no earlier one has answered, failed rows included."""
    options = {} if preset is None else dict(question_template=preset.question_template, question_options=preset.question_options,
                                             answer_options=preset.answer_options)
    qa = jn.generate_journalled(chunks, generator_factory or (lambda: None), f"{root}/{base}_journal", keys=keys, index_col=index_col,
                                n_questions=n_questions, keep=keep, partitions=model_partitions, **options)
    return sk.materialize(qa, f"{root}/{base}_qa_raw.parquet")


def _tail(spark: SparkSession, chunks: DataFrame, out_dir: str, index_col: str, keep: list[str],
          generator_factory, encoder_factory, n_questions: int, output_format: str,
          save_individual: bool, chunk_name: str, qa_name: str, source_file: str,
          batch_size: int, datapoint_files: bool, run: str | None, preset: gn.Preset | None,
          model_partitions: int | None, input_root: str | None = None) -> dict:
    root = out_dir.rstrip("/")
    base = run or sk.timestamped_base()
    keys = keep + [index_col]
    observed, progress = with_progress(chunks, "chunks", "chunk")  # running totals, reported at the end
    chunks = sk.materialize(observed, f"{root}/{base}_chunks.parquet")
    qa = _generated(spark, chunks, root, base, keys, keep, generator_factory, n_questions,
                    index_col, preset, model_partitions)
    emb = None
    if encoder_factory is not None:
        # computed once, written once by the export as the embeddings table
        emb = em.embed(spread(chunks, keys, model_partitions), encoder_factory, text_col="chunk", batch_size=batch_size)
    outputs = sk.export_qa(qa.drop("error"), root, base, output_format, embeddings=emb,
                           embedding_keys=keys, source_file=source_file, stored=True,
                           datapoint_files=datapoint_files)
    outputs["qa_parquet"] = f"{root}/{base}_qa_raw.parquet"
    if emb is not None:
        emb = spark.read.parquet(outputs["embeddings"])
    if save_individual:
        prefix = "path" if keep else None
        cf = fm.chunk_files(chunks, chunk_name, key=index_col, prefix_col=prefix, root=input_root)
        qf = fm.chunk_qa_files(qa, qa_name, prefix_col=prefix, root=input_root)
        sk.write_files(cf, f"{root}/{base}_individual")
        sk.write_files(qf, f"{root}/{base}_individual")
        outputs["individual"] = f"{root}/{base}_individual"
    summary = st.run_summary(chunks, qa, emb if emb is not None else chunks.filter(F.lit(False))).first()
    outputs["summary"] = summary.asDict()
    outputs["chunk_progress"] = progress.get
    outputs["errors"] = qa.filter(F.col("error").isNotNull()).count()
    return outputs


def document_texts(spark: SparkSession, path: str, out: str, max_pages: int | None = None,
                   pdf_extractor_factory: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): one row (path, text) per readable file under ``path``,
    and one row (path, error) for each that is not: another type, a PDF without an
    extractor, a PDF whose extraction failed. Pages are extracted once and
    stored at ``out``."""
    files = rd.read_binary_files(spark, path)
    parts = rd.split_by_extension(files)
    docs = rd.text_files_frame(parts["txt"])
    errors = parts["unsupported"].select("path", F.lit("not a PDF or text file").alias("error"))
    if pdf_extractor_factory is None:
        errors = errors.unionByName(parts["pdf"].select("path", F.lit("no PDF extractor given").alias("error")))
    else:
        pages = sk.materialize(rd.read_pdf_pages(spark, path, pdf_extractor_factory, max_pages=max_pages, with_errors=True), out)
        failed = pages.filter("error is not null").select("path", "error")
        good = pages.filter("error is null").join(failed.select("path"), "path", "left_anti").drop("error")
        docs = docs.unionByName(pg.join_pages(good, ["path"], max_pages))
        errors = errors.unionByName(failed)
    return docs, errors


def build_from_documents(spark: SparkSession, path: str, out_dir: str,
                         generator_factory: Callable | None = None, encoder_factory: Callable | None = None,
                         size: int = ch.DEFAULT_CHUNK_SIZE, overlap: int = ch.DEFAULT_CHUNK_OVERLAP,
                         n_questions: int = gn.DEFAULT_QUESTIONS_PER_CHUNK, max_pages: int | None = None,
                         pdf_extractor_factory: Callable | None = None, output_format: str = "all",
                         save_individual: bool = False, batch_size: int = em.DEFAULT_BATCH_SIZE,
                         datapoint_files: bool = False, run: str | None = None, preset: gn.Preset | None = None,
                         model_partitions: int | None = None) -> dict:
    """TXT and PDF files under ``path`` -> chunks -> QA -> vectors -> exports.
    Chunks are keyed by (path, chunk_index); ids use the chunk index, and the QA
    rows keep the path. Files that cannot be read are listed under ``input_errors``;
    a single file that cannot be read is an error. ``run`` names the outputs: a second
    call of the same name resumes, asking the model only for what has no answer yet."""
    rd.check_document_path(spark, path)
    base = run or sk.timestamped_base()
    docs, errors = document_texts(spark, path, f"{out_dir.rstrip('/')}/{base}_pages.parquet", max_pages, pdf_extractor_factory)
    errors = sk.materialize(errors, f"{out_dir.rstrip('/')}/{base}_input_errors.parquet")
    n_errors = errors.count()
    if n_errors and docs.isEmpty():
        first = errors.first()
        raise ValueError(f"nothing could be read; {first['path']}: {first['error']}")
    chunks = ch.chunk_text(spread(docs, "path", model_partitions), text_col="text", size=size, overlap=overlap, keep=["path"])
    out = _tail(spark, chunks, out_dir, "chunk_index", ["path"], generator_factory, encoder_factory,
                n_questions, output_format, save_individual, tx.CHUNK_FILE_FORMAT, tx.CHUNK_QA_FILE_FORMAT,
                path, batch_size, datapoint_files, base, preset, model_partitions, sk.qualified(spark, path))
    return out | {"input_errors": n_errors, "input_errors_parquet": f"{out_dir.rstrip('/')}/{base}_input_errors.parquet"}


def table_chunks(df: DataFrame, text_col: str = "text", start_index: int = 0,
                 max_samples: int | None = None, bare_scan: bool = False) -> DataFrame:
    """The table path up to chunks: validate the column, attach row positions
    (``bare_scan``: df is an unfiltered file scan), slice, keep valid text of at
    least 10 characters, wrap in the banner."""
    rw.require_text_column(df, text_col)
    indexed = rw.with_row_index(df, bare_scan=bare_scan)
    sliced = rw.slice_rows(indexed, start_index, max_samples)
    return rw.dataset_chunks(sliced, text_col)


def build_from_table(spark: SparkSession, source: str, out_dir: str, text_col: str = "text",
                     file_type: str = "auto", named: bool = False, split: str | None = "train",
                     config: str | None = None, start_index: int = 0, max_samples: int | None = None,
                     generator_factory: Callable | None = None, encoder_factory: Callable | None = None,
                     n_questions: int = gn.DEFAULT_QUESTIONS_PER_CHUNK, output_format: str = "all",
                     save_individual: bool = False, batch_size: int = em.DEFAULT_BATCH_SIZE,
                     datapoint_files: bool = False, run: str | None = None, preset: gn.Preset | None = None,
                     model_partitions: int | None = None) -> dict:
    """A table of text (file or named dataset) -> dataset chunks -> QA -> vectors
    -> exports. Chunks are keyed by the row's position (real_index)."""
    df = (rd.read_named(spark, source, split, config) if named
          else rd.read_table(spark, source, file_type))
    chunks = table_chunks(df, text_col, start_index, max_samples, bare_scan=not named)
    names = ((tx.DATASET_CHUNK_FILE_FORMAT, tx.DATASET_CHUNK_QA_FILE_FORMAT) if named
             else (tx.TABLE_CHUNK_FILE_FORMAT, tx.TABLE_CHUNK_QA_FILE_FORMAT))
    return _tail(spark, chunks, out_dir, "real_index", [], generator_factory, encoder_factory, n_questions,
                 output_format, save_individual, names[0], names[1], source, batch_size, datapoint_files, run, preset,
                 model_partitions)


def build_from_tables(spark: SparkSession, sources: list[str], out_dir: str, text_col: str = "text", file_type: str = "auto",
                      run: str | None = None, generator_factory: Callable | None = None, encoder_factory: Callable | None = None,
                      n_questions: int = gn.DEFAULT_QUESTIONS_PER_CHUNK, output_format: str = "all", save_individual: bool = False,
                      batch_size: int = em.DEFAULT_BATCH_SIZE, datapoint_files: bool = False, preset: gn.Preset | None = None,
                      model_partitions: int | None = None) -> dict:
    """Several tables of text as one: their rows in the order of the stored copy -> dataset chunks -> QA ->
    vectors -> exports. A source, a file of it or a record that cannot be read is listed under
    ``input_errors`` and the rest goes on; where nothing can be read, that is an error. A second call
    with the same ``run`` reads the stored rows again, so their positions stay."""
    base = run or sk.timestamped_base()
    root = out_dir.rstrip("/")
    rows_at, errors_at = f"{root}/{base}_rows.parquet", f"{root}/{base}_input_errors.parquet"
    if not jn.exists(spark, f"{rows_at}/_SUCCESS"):
        rows, errors = qr.read_quarantined(spark, sources, f"{root}/{base}_inputs", [text_col], file_type)
        errors = sk.materialize(errors, errors_at)
        if rows.isEmpty() and (first := errors.first()):
            raise ValueError(f"nothing could be read; {first['path']}: {first['error']}")
        sk.materialize(rows, rows_at)
    chunks = table_chunks(spark.read.parquet(rows_at), text_col, bare_scan=True)
    out = _tail(spark, chunks, out_dir, "real_index", [], generator_factory, encoder_factory, n_questions, output_format, save_individual,
                tx.TABLE_CHUNK_FILE_FORMAT, tx.TABLE_CHUNK_QA_FILE_FORMAT, ", ".join(sources), batch_size, datapoint_files, base, preset, model_partitions)
    return out | {"input_errors": spark.read.parquet(errors_at).count(), "input_errors_parquet": errors_at}
