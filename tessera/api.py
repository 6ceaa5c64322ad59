"""The public surface in one place (names follow the survey's API sketch).

    from tessera import api
    chunks = api.chunk_text(api.read_table(spark, "docs.parquet"))
"""
from tessera.functions.decode import decode_text  # noqa: F401
from tessera.functions.text import (chunk_clean, clean_page, clean_txt, paragraphs, preview, qa_id,  # noqa: F401
                                    sentence_boundary, split_sentences, valid_text, wrap_dataset_chunk,
                                    ws_collapse, ws_trim)
from tessera.operators.chunk import (chunk_by_sentences, chunk_text, explode_paragraphs,  # noqa: F401
                                     explode_sentences)
from tessera.operators.chunk_blocks import chunk_text_blocks  # noqa: F401
from tessera.operators.combine import read_many, union_missing_cols, union_sources  # noqa: F401
from tessera.operators.embed import HashingEncoder, embed, embedding_dim, mean_pool, padding_report  # noqa: F401
from tessera.operators.formats import (alpaca_datapoint_files, chunk_files, chunk_qa_files,  # noqa: F401
                                       qa_pair_files, to_alpaca, to_chat, to_instruction,
                                       to_instruction_with_id)
from tessera.operators.generate import (FirstSentenceGenerator, answer_prompt, drop_failed,  # noqa: F401
                                        generate_qa, qa_pairs, question_fanout, question_prompt)
from tessera.operators.journal import generate_journalled, read_journal  # noqa: F401
from tessera.operators.pages import (clean_pages, join_pages, page_limit, page_stats,  # noqa: F401
                                     pages_drop_blank, pages_from_text_layer, pages_keep_blank)
from tessera.operators.rows import (dataset_chunks, filter_min_length, filter_valid_text,  # noqa: F401
                                    require_text_column, slice_rows, with_row_index, zip_index)
from tessera.operators.search import centroid, cosine, top_k, top_k_single  # noqa: F401
from tessera.operators.search_pruned import top_k_pruned  # noqa: F401
from tessera.operators.stats import (chunk_stats, dataset_chunk_stats, metadata, qa_stats,  # noqa: F401
                                     question_type_counts, run_summary)
from tessera.plans.flows import build_from_documents, build_from_table, build_from_tables, table_chunks  # noqa: F401
from tessera.session import checkpoint_root, get_spark  # noqa: F401
from tessera.sources.quarantine import merged_schema, read_quarantined  # noqa: F401
from tessera.sources.readers import (check_document_path, dataset_info, detect_format,  # noqa: F401
                                     read_binary_files, read_named, read_pdf_pages, read_table,
                                     read_text_files, split_by_extension)
from tessera.sources.sinks import (export_qa, materialize, write_csv, write_embeddings,  # noqa: F401
                                   write_files, write_json)
from tessera.sources.split_csv import csv_records, read_csv_split  # noqa: F401
from tessera.streaming.incremental import (resume_anti, running_qa_stats, stream_documents_to_qa,  # noqa: F401
                                           stream_text_files, with_progress)
