"""Command-line front end (``python -m tessera`` or ``spark-submit``) with the
reference's input modes and data options; it only parses arguments and calls
the flows in ``tessera.plans.flows``.

Model back ends are plug-ins given as ``module:factory`` import strings; the
factory is called once per task (with ``--generator-arg key=value`` pairs as
keyword arguments). Without a generator no QA rows are produced, as in the
reference when no model is available."""
from __future__ import annotations

import argparse
import importlib
import json
import sys

from tessera.operators.chunk import DEFAULT_CHUNK_OVERLAP, DEFAULT_CHUNK_SIZE
from tessera.operators.embed import DEFAULT_BATCH_SIZE
from tessera.operators.generate import DEFAULT_QUESTIONS_PER_CHUNK, api_preset, local_preset


def _factory(spec: str | None, kv: list[str]):
    if not spec:
        return None
    mod, _, attr = spec.partition(":")
    target = getattr(importlib.import_module(mod), attr)
    kwargs = dict(item.split("=", 1) for item in kv)
    return lambda: target(**kwargs)


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera", description="Instruction datasets from documents and tables, on Spark")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--file", help="a .txt/.pdf file or a folder of them")
    src.add_argument("--dataset", help="a catalog table (or Parquet path) read as a named dataset")
    src.add_argument("--dataset-file", help="a CSV / JSON / JSONL / Parquet table of text")
    src.add_argument("--dataset-info", help="print information about a named dataset")
    p.add_argument("--dataset-split", default="train")
    p.add_argument("--dataset-config", default=None)
    p.add_argument("--text-column", default="text")
    p.add_argument("--file-type", default="auto", choices=["auto", "csv", "json", "jsonl", "parquet"])
    p.add_argument("--max-samples", type=int, default=None)
    p.add_argument("--start-index", type=int, default=0)
    p.add_argument("--chunk-size", type=int, default=DEFAULT_CHUNK_SIZE)
    p.add_argument("--chunk-overlap", type=int, default=DEFAULT_CHUNK_OVERLAP)
    p.add_argument("--max-pages", type=int, default=None)
    p.add_argument("--questions-per-chunk", type=int, default=DEFAULT_QUESTIONS_PER_CHUNK)
    p.add_argument("--batch-size", type=int, default=DEFAULT_BATCH_SIZE)
    p.add_argument("--output-dir", default="output")
    p.add_argument("--output-format", default="all", choices=["json", "csv", "all"])
    p.add_argument("--save-individual", action=argparse.BooleanOptionalAction, default=False,
                   help="also write one file per chunk and per QA pair")
    p.add_argument("--datapoint-files", action=argparse.BooleanOptionalAction, default=False,
                   help="also write one file per Alpaca record in the 'all' export")
    p.add_argument("--run", default=None, help="name of the outputs; the same name again resumes that run")
    p.add_argument("--preset", default="api", choices=["api", "local"], help="prompt template and call options")
    p.add_argument("--model", default=None, help="model name passed on to the generator (api preset)")
    p.add_argument("--temperature", type=float, default=0.7)
    p.add_argument("--top-p", type=float, default=0.9)
    p.add_argument("--do-sample", action=argparse.BooleanOptionalAction, default=True)
    p.add_argument("--model-partitions", type=int, default=None, help="deal rows into so many tasks before model calls")
    p.add_argument("--generator", help="module:factory returning an object with generate(list[str], **opts)")
    p.add_argument("--generator-arg", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--encoder", help="module:factory returning an object with encode(list[str])")
    p.add_argument("--encoder-arg", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--pdf-extractor", help="module:factory returning a callable bytes -> list of page texts")
    p.add_argument("--master", default=None, help="Spark master (left to spark-submit when omitted)")
    return p


def main(argv: list[str] | None = None) -> int:
    args = build_parser().parse_args(argv)
    from tessera.plans import flows
    from tessera.session import get_spark
    from tessera.sources import readers as rd

    spark = get_spark(args.master)
    gen = _factory(args.generator, args.generator_arg)
    enc = _factory(args.encoder, args.encoder_arg)
    if args.dataset_info:
        df = rd.read_named(spark, args.dataset_info, args.dataset_split, args.dataset_config)
        info = rd.dataset_info(df, args.dataset_info, args.dataset_split, args.dataset_config,
                               args.text_column).first().asDict(recursive=True)
        print(json.dumps(info, ensure_ascii=False, indent=2, default=str))
        return 0
    preset = (api_preset(args.model, args.temperature, args.top_p) if args.preset == "api"
              else local_preset(args.temperature, args.top_p, args.do_sample))
    common = dict(generator_factory=gen, encoder_factory=enc, n_questions=args.questions_per_chunk,
                  output_format=args.output_format, save_individual=args.save_individual,
                  batch_size=args.batch_size, datapoint_files=args.datapoint_files, run=args.run, preset=preset,
                  model_partitions=args.model_partitions)
    if args.file:
        out = flows.build_from_documents(spark, args.file, args.output_dir, size=args.chunk_size,
                                         overlap=args.chunk_overlap, max_pages=args.max_pages,
                                         pdf_extractor_factory=_factory(args.pdf_extractor, []), **common)
    else:
        out = flows.build_from_table(spark, args.dataset or args.dataset_file, args.output_dir,
                                     text_col=args.text_column, file_type=args.file_type,
                                     named=bool(args.dataset), split=args.dataset_split,
                                     config=args.dataset_config, start_index=args.start_index,
                                     max_samples=args.max_samples, **common)
    print(json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
