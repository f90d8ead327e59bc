import json
import os

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quern.operators import bpe
from quern.sources import files, sinks
from quern.streaming import streams

TALK = [{"role": "user", "content": "hi"}, {"role": "assistant", "content": "hello"}]


def test_shards_and_splits(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(f"t{k}",)], "text string").coalesce(1).write.parquet(str(tmp_path / f"x{k}"))
        part = next(p for p in (tmp_path / f"x{k}").iterdir() if p.name.startswith("part"))
        os.makedirs(tmp_path / "c", exist_ok=True)
        os.rename(part, tmp_path / "c" / f"shard_{k:05d}.parquet")
    (tmp_path / "c" / "shard_00009.parquet.tmp").write_text("no")
    rows = files.shards(spark, str(tmp_path / "missing"), str(tmp_path / "c"))
    assert [r.text for r in files.split_shards(rows, "val").collect()] == ["t2"]
    assert sorted(r.text for r in files.split_shards(rows, "train").collect()) == ["t0", "t1"]
    with pytest.raises(ValueError):
        files.split_shards(rows, "test")


def test_conversation_lines(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("\n".join([json.dumps(TALK), "", "  ", json.dumps(TALK[:1])]))
    assert files.conversations(spark, str(path), strict=False).count() == 1
    with pytest.raises(Exception, match="not a conversation"):
        files.conversations(spark, str(path)).collect()


def test_settings_and_tables(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("icl_tasks:\n- {label: a, icl_task_type: schema, dataset_uri: u, num_fewshot: [3]}\n- {label: b, icl_task_type: schema, dataset_uri: u, num_fewshot: [0], continuation_delimiter: '-'}\n")
    assert [(r.label, r.num_fewshot, r.continuation_delimiter) for r in files.task_settings(spark, str(tmp_path / "c.yaml")).collect()] == [("a", 3, " "), ("b", 0, "-")]
    (tmp_path / "b.csv").write_text("Eval Task,Random baseline\na,25\n")
    assert files.baselines(spark, str(tmp_path / "b.csv")).first().baseline == 25.0
    os.makedirs(tmp_path / "t" / "train")
    (tmp_path / "t" / "train" / "x.json").write_text('{"question": "q", "answer": "a"}\n{"question": "r", "answer": "b"}\n')
    assert sorted(r.idx for r in files.task(spark, str(tmp_path / "t"), "word_problem", "train").collect()) == [0, 1]
    with pytest.raises(ValueError):
        files.task(spark, str(tmp_path / "t"), "word_problem", "dev")
    done = files.completed_config(spark.createDataFrame([(1, None)], "a int, w string"), {"w": "L", "n": 0})
    assert done.first().asDict() == {"a": 1, "w": "L", "n": 0}


def test_checkpoint_folders(spark, tmp_path):
    for name in ("d4", "d12", "other"):
        os.makedirs(tmp_path / "base_checkpoints" / name)
    for step in (5, 100):
        (tmp_path / "base_checkpoints" / "d12" / f"model_{step:06d}.pt").write_text("")
    assert files.model_folder(spark, str(tmp_path), "base") == (str(tmp_path / "base_checkpoints" / "d12"), 100)
    with pytest.raises(FileNotFoundError):
        files.last_step(spark, str(tmp_path))


def test_written_shards_hold_whole_groups(spark, tmp_path):
    rows = spark.range(100).select(F.col("id"), F.lit("abcde").alias("text"))
    got = sinks.write_shards(rows, str(tmp_path / "s"), [F.col("id")], chars=100, rows=8)
    assert sorted((r.shard, r.docs) for r in got.collect()) == [(0, 24), (1, 24), (2, 24), (3, 24)]
    assert files.shard_names(spark, str(tmp_path / "s")) == [f"shard_{k:05d}.parquet" for k in range(4)] and len(os.listdir(tmp_path / "s")) <= 8  # with checksums
    back = [r.id for r in spark.read.parquet(str(tmp_path / "s")).select(F.monotonically_increasing_id().alias("id")).collect()]
    assert len(back) == 96
    meta = pq.ParquetFile(tmp_path / "s" / "shard_00002.parquet").metadata
    assert meta.num_rows == 24 and meta.num_row_groups == 3 and meta.row_group(0).column(0).compression == "ZSTD"
    assert sinks.write_shards(rows.limit(3), str(tmp_path / "few"), [F.col("id")], chars=100, rows=8).collect() == [] and files.shard_names(spark, str(tmp_path / "few")) == []


def test_append_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = spark.createDataFrame([(1.0, 8, 0.5), (1.0, 8, 0.5), (2.0, 8, 0.4)], "flops double, depth int, bpb double")
    assert sinks.append_new(rows, path, ["flops", "depth"]) == 2
    assert sinks.append_new(rows, path, ["flops", "depth"]) == 0
    assert spark.read.option("header", True).csv(path).count() == 2


def test_sections(spark, tmp_path):
    path = sinks.write_section(spark, str(tmp_path), "Base model", [{"a": 0.5, "b": 12345, "c": 9999}, None, "text\n"], "2030-01-01 00:00:00")
    assert os.path.basename(path) == "base-model.md"
    assert "- a: 0.5000\n- b: 12,345\n- c: 9999\ntext\n" in open(path, encoding="utf-8").read()


def test_report(spark, tmp_path):
    folder, expected = str(tmp_path / "r"), ["base-eval.md", "chat-sft.md", "chat-rl.md", "never.md"]
    stages = {"base": ("base-eval.md", ["CORE"]), "sft": ("chat-sft.md", ["ARC", "ChatCORE"]), "rl": ("chat-rl.md", ["GSM"])}
    assert "Total wall clock time: unknown\n" in open(sinks.write_report(spark, folder, expected, stages), encoding="utf-8").read()
    sinks.reset_report(spark, folder, expected, "# Report\nRun started: 2030-01-01 10:00:00\n### Bloat\n- lines: 5\n\n")
    sinks.write_section(spark, folder, "base eval", [{"CORE": 0.25}], "2030-01-01 11:00:00")
    sinks.write_section(spark, folder, "chat sft", [{"ARC": 0.5, "ChatCORE": 0.125}], "2030-01-01 12:30:59")
    sinks.write_section(spark, folder, "chat rl", [{"GSM": "x"}], "2030-01-02 12:00:00")
    text = open(sinks.write_report(spark, folder, expected, stages), encoding="utf-8").read()
    assert text.startswith("# Report\n") and text.index("## base eval") < text.index("## chat sft") < text.index("## chat rl") < text.index("## Summary\n\n- lines: 5\n\n")
    table = [line for line in text.split("\n") if line.startswith("|")]
    assert table[0] == "| Metric          | BASE     | SFT      | RL       |" and table[1] == "|-----------------|----------|----------|----------|"
    assert table[2:] == ["| CORE            | 0.2500   | -        | -        |", "| ARC             | -        | 0.5000   | -        |", "| GSM             | -        | -        | x        |", "| ChatCORE        | -        | 0.1250   | -        |"]
    assert text.endswith("Total wall clock time: 2h30m\n")


def test_result_table_as_a_file(spark, tmp_path):
    from quern.operators import reports

    results = spark.createDataFrame([("b", 0.5, 0.25), ("a", 1.0, 1.0)], "task string, accuracy double, centered double")
    path = str(tmp_path / "core.csv")
    sinks.write_results(reports.result_lines(results), path)
    lines = open(path, encoding="utf-8").read().split("\n")
    assert [x.split(",")[0].strip() for x in lines[:4]] == ["Task", "a", "b", "CORE"] and lines[3].split(",")[2].strip() == "0.625000"
    assert lines[1] == f"{'a':<35}, {1.0:<10.6f}, {1.0:<10.6f}" and lines[0] == f"{'Task':<35}, {'Accuracy':<10}, {'Centered':<10}"


def test_conversations_and_tokenizer_survive(spark, tmp_path):
    rows = spark.createDataFrame([(TALK,)], "messages array<struct<role: string, content: string>>")
    sinks.append_conversations(rows, str(tmp_path / "c"))
    assert files.conversations(spark, str(tmp_path / "c")).count() == 1
    merges = bpe.learn_merges({"abab": 3, "abc": 1}, 2)
    sinks.save_tokenizer(spark, merges, str(tmp_path / "t"))
    assert files.tokenizer(spark, str(tmp_path / "t")) == merges == [(97, 98), (256, 256)]


def test_bpe_round_trip_and_token_bytes(spark):
    texts = [None, "", "aé日👍 12345", "don't  stop\n\n x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    merges = bpe.train(rows, 256 + 9 + 5)
    back = {r.doc_id: r.t for r in bpe.encode(rows, merges).select("doc_id", bpe.decode(F.col("ids"), merges).alias("t")).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    table = {r.token_id: r.n_bytes for r in bpe.vocabulary_table(spark, []).collect()}
    assert table[0xE4] == 3 and table[65] == 1 and table[256] == 0
    with pytest.raises(ValueError):
        bpe.train(rows, 100)


def test_generation_forces_the_result_of_a_call(spark):
    script = [1, 500, *b"1+2", 501, 7, 999, 8]
    machine = streams.Automaton(500, 501, 502, 503, (999,), lambda e: __import__("quern.operators.evals", fromlist=["x"]).calculate(e))
    rows = spark.createDataFrame([(1, 0), (1, 1)], "k bigint, r bigint")
    got = streams.generated(rows, "k", "r", 20, lambda k, r, at: script[at] if at < 6 else [7, 7, 7, 999][min(at - 6, 3)], machine).orderBy("row", "step").collect()
    first = [(x.token, x.mask) for x in got if x.row == 0]
    assert first == [(1, 1), (500, 1), (49, 1), (43, 1), (50, 1), (501, 1), (502, 0), (51, 0), (503, 0), (999, 1)]
    assert first == [(x.token, x.mask) for x in got if x.row == 1]


def test_samples_share_a_prefill_and_keep_state(spark):
    class Countdown:
        """Counts down from a prompt's last token; its sample is the count, a row's number more at first."""

        def __init__(self):
            self.reads = 0

        def prefill(self, ids):
            self.reads += 1
            return (ids[-1], self.reads)

        def sample(self, state, row, step):
            return state[0] + (row if step == 0 else 0)

        def advance(self, state, token):
            return (token - 1, state[1])

    machine = streams.Automaton(500, 501, 502, 503, (0,), lambda e: None)
    prompts = spark.createDataFrame([(1, [9, 3]), (2, [1])], "k bigint, ids array<int>").coalesce(1)
    got = streams.continued(prompts, "k", "ids", 2, 10, Countdown(), machine).collect()
    rows = {}
    for x in sorted(got, key=lambda x: (x.key, x.row, x.step)):
        rows.setdefault((x.key, x.row), []).append(x.token)
    assert rows == {(1, 0): [3, 2, 1, 0], (1, 1): [4, 3, 2, 1, 0], (2, 0): [1, 0], (2, 1): [2, 1, 0]}


def test_only_whole_characters_are_shown(spark):
    df = spark.createDataFrame([("aé👍",), ("",), (None,)], "t string")
    got = [r.p for r in bpe.encode(df.withColumn("k", F.monotonically_increasing_id()), [], "k", "t").select(bpe.streamed(F.col("ids"), []).alias("p")).collect()]
    assert sorted(got, key=len, reverse=True)[0] == ["a", "", "é", "", "", "", "👍"]


def test_stream_to_lines(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "text string").write.parquet(str(tmp_path / "in"))
    stream = streams.corpus_stream(spark, str(tmp_path / "in"), "text string")
    streams.to_lines(stream.select(sinks.events(F.col("text"), F.lit(0)).alias("line")), str(tmp_path / "out"), str(tmp_path / "cp"), "line").awaitTermination()
    lines = [r.value for r in spark.read.option("recursiveFileLookup", True).text(str(tmp_path / "out")).where("value <> ''").collect()]
    assert sorted(lines) == ['data: {"token":"a","gpu":0}', 'data: {"token":"b","gpu":0}']
