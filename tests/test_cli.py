import json
import os

from tessera.__main__ import build_parser, main


def test_parser_defaults():
    a = build_parser().parse_args(["--dataset-file", "x.csv"])
    assert (a.chunk_size, a.chunk_overlap, a.questions_per_chunk, a.output_format) == (1000, 200, 3, "all")


def test_cli_table_run(spark, tmp_out, capsys):
    src = os.path.join(tmp_out, "t.parquet")
    spark.createDataFrame([(i, f"row {i} has enough text.") for i in range(5)], "id long, text string") \
        .coalesce(1).write.parquet(src)
    rc = main(["--dataset-file", src, "--output-dir", os.path.join(tmp_out, "o"), "--output-format", "json",
               "--questions-per-chunk", "2", "--start-index", "1", "--max-samples", "3",
               "--generator", "tessera.operators.generate:FirstSentenceGenerator", "--no-save-individual"])
    assert rc == 0
    out = json.loads(capsys.readouterr().out)
    assert out["summary"]["text_chunks"] == 3 and out["summary"]["qa_pairs"] == 6


def test_cli_dataset_info(spark, tmp_out, capsys):
    src = os.path.join(tmp_out, "named")
    spark.createDataFrame([("a" * 120, "train"), ("b", "test")], "text string, split string").write.parquet(src)
    assert main(["--dataset-info", src]) == 0
    info = json.loads(capsys.readouterr().out)
    assert info["total_samples"] == 1 and info["sample_data"]["text"] == "a" * 100 + "..."


def test_api_surface_imports():
    from tessera import api
    for name in ("read_table", "chunk_text", "qa_pairs", "embed", "top_k", "to_chat", "qa_stats",
                 "write_json", "stream_text_files", "build_from_table"):
        assert callable(getattr(api, name))


def test_parser_scale_flags():
    a = build_parser().parse_args(["--file", "docs/"])
    assert not a.save_individual and not a.datapoint_files and a.run is None
    a = build_parser().parse_args(["--file", "docs/", "--save-individual", "--datapoint-files", "--run", "r", "--preset", "local",
                                   "--temperature", "0.2", "--top-p", "0.5", "--no-do-sample"])
    assert a.save_individual and a.datapoint_files and (a.run, a.preset, a.temperature, a.top_p, a.do_sample) == ("r", "local", 0.2, 0.5, False)
