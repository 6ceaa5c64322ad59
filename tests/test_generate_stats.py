from pyspark.sql import functions as F

from tessera.operators import formats as fm
from tessera.operators import generate as gn
from tessera.operators import stats as st


class FlakyGenerator:
    """Fails any batch that contains a prompt mentioning 'boom'."""

    def generate(self, prompts, **_):
        if any("boom" in p for p in prompts):
            raise RuntimeError("model error")
        return ["  out: " + p[-5:] + "  " for p in prompts]


def _chunks(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "real_index long, chunk string")


def test_generate_two_step_and_failures(spark):
    qa = gn.generate_qa(_chunks(spark, ["alpha text.", "boom text.", "gamma."]), FlakyGenerator, n_questions=2)
    rows = {(r.chunk_index, r.question_index): r for r in qa.collect()}
    assert len(rows) == 6                                   # failed rows stay
    assert rows[(1, 0)].question == "" and rows[(1, 0)].answer == "" and "model error" in rows[(1, 0)].error
    ok = rows[(0, 1)]
    assert ok.id == "dataset_0_question_1" and ok.question == "out: text." and ok.error is None
    assert ok.answer.startswith("out: ")                    # outer strip on model output


def test_unavailable_model_and_zero_questions(spark):
    c = _chunks(spark, ["alpha."])
    assert gn.generate_qa(c, lambda: None).count() == 0
    assert gn.generate_qa(c, gn.FirstSentenceGenerator, n_questions=0).count() == 0
    assert gn.question_fanout(c, 0).count() == 0
    assert sorted(r.question_index for r in gn.question_fanout(c, 3).collect()) == [0, 1, 2]


def test_stub_generator_and_prompts(spark):
    qa = gn.generate_qa(_chunks(spark, ["  First one. Second!"]), gn.FirstSentenceGenerator, n_questions=1)
    r = qa.first()
    assert (r.question, r.answer) == ("First one?", "First one")
    p = _chunks(spark, ["ctx"]).select(gn.question_prompt("chunk"), gn.answer_prompt("chunk", F.lit("q?"))).first()
    assert p[0].endswith("\n\nText: ctx") and p[1].endswith("\n\nText: ctx\n\nQuestion: q?")


def _qa(spark):
    rows = [("id0", "q one", "answer", "ctx", 0, 0, "factual"), ("id1", "q2", "ans", "ctx", 1, 0, None)]
    return spark.createDataFrame(rows, "id string, question string, answer string, context string, "
                                       "question_index int, chunk_index long, question_type string")


def test_formats(spark):
    qa = _qa(spark)
    assert fm.to_instruction_with_id(qa).columns == ["instruction", "input", "output", "id"]
    chat = fm.to_chat(qa).orderBy(F.col("messages")[0]["content"]).first().messages
    assert [(m.role, m.content) for m in chat] == [("user", "q one"), ("assistant", "answer")]
    files = {r.file_name: r.body for r in fm.alpaca_datapoint_files(qa).collect()}
    assert set(files) == {"datapoint_0.json", "datapoint_1.json"}
    import json
    assert json.loads(files["datapoint_0.json"]) == {"instruction": "q one", "input": "", "output": "answer"}
    assert files["datapoint_0.json"] == json.dumps({"instruction": "q one", "input": "", "output": "answer"},
                                                   indent=2, ensure_ascii=False)


def test_stats_and_metadata(spark):
    qa = _qa(spark)
    s = st.qa_stats(qa).first()
    assert s.total_pairs == 2 and s.avg_question_length == 3.5
    counts = {r.question_type: r.n for r in st.question_type_counts(qa).collect()}
    assert counts == {"factual": 1, "unknown": 1}
    m = st.metadata(qa, "/data/book.pdf").first()
    assert m.dataset_info.name == "Generated from book" and m.dataset_info.total_qa_pairs == 2
    assert m.statistics.question_types == {"factual": 1, "unknown": 1}
    empty = qa.filter(F.lit(False))
    assert st.qa_stats(empty).first().avg_question_length is None
    summ = st.run_summary(qa.select("id"), qa, qa.filter(F.lit(False))).first()
    assert (summ.text_chunks, summ.qa_pairs, summ.embeddings, summ.qa_per_chunk) == (2, 2, 0, 1.0)
    assert st.run_summary(empty, empty, empty).first().qa_per_chunk is None


def test_drop_failed(spark):
    qa = gn.generate_qa(_chunks(spark, ["alpha text.", "boom text."]), FlakyGenerator, n_questions=1)
    assert qa.count() == 2
    kept = gn.drop_failed(qa).collect()
    assert [r.chunk_index for r in kept] == [0]


def test_batches_null_contexts_and_bisection(spark):
    class Counting:
        def generate(self, prompts, **_):
            assert len(prompts) <= 4
            if any("boom" in p for p in prompts):
                raise RuntimeError("model error")
            return [f"of {len(prompts)}" for _ in prompts]

    texts = ["t"] * 9 + ["boom", None]
    qa = gn.generate_qa(_chunks(spark, texts).coalesce(1), Counting, n_questions=1, batch_size=4).collect()
    by = {r.chunk_index: r for r in qa}
    assert len(by) == 11 and by[10].error == "no context" and "model error" in by[9].error
    assert {by[i].question for i in range(8)} == {"of 4"} and by[8].error is None


def test_presets():
    local, api = gn.local_preset(temperature=0.1, do_sample=False), gn.api_preset("m", top_p=0.5)
    assert local.answer_options == {"max_new_tokens": 200, "temperature": 0.1, "top_p": 0.9, "do_sample": False}
    assert local.question_options == {"max_new_tokens": 2048} and local.question_template.startswith("Based on the following Arabic text, generate one")
    assert api.question_options == api.answer_options == {"max_tokens": 2048, "temperature": 0.7, "top_p": 0.5, "n": 1, "model": "m"}


def test_contexts_need_not_travel_back(spark):
    c = _chunks(spark, ["alpha text.", "boom text."])
    whole = gn.generate_qa(c, FlakyGenerator, n_questions=2)
    lean = gn.generate_qa(c, FlakyGenerator, n_questions=2, with_context=False)
    assert lean.columns == [x for x in whole.columns if x != "context"]
    assert sorted(map(str, lean.collect())) == sorted(map(str, whole.drop("context").collect()))
