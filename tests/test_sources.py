import json
import zipfile

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillmill.operators import records, tokens
from quillmill.plans import corpus, ingest, instruction
from quillmill.sources import files, formats, jsonl, sinks
from quillmill.streaming import resumable


def put(root, **texts):
    for name, text in texts.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


def test_scan_and_inventory(spark, tmp_path):
    put(tmp_path, **{"a/b.TXT": "abcd", "a-b.md": b"x\xff", "c.csv": "no", "d e+f.text": " ", "p.pdf": b"12", "q.pdf": b"12"})
    got = files.text_files(spark, str(tmp_path)).orderBy(files.path_order(F.col("relative"))).collect()
    assert [(r["relative"], r["text"]) for r in got] == [("a/b.TXT", "abcd"), ("a-b.md", "x�")]
    inv = files.inventory(files.scan(spark, str(tmp_path), files.CORPUS_SUFFIXES)).first()
    assert (inv["total_files"], inv["total_size_bytes"]) == (5, 11) and inv["extensions"] == {".txt": 1, ".md": 1, ".text": 1, ".pdf": 2}
    assert files.duplicate_files(files.scan(spark, str(tmp_path))).first()["paths"] == ["p.pdf", "q.pdf"]
    report = files.pdf_report(files.scan(spark, str(tmp_path))).collect()
    assert len(report) == 2 and all(r["error"] and r["words"] is None for r in report)
    with pytest.raises(FileNotFoundError):
        files.scan(spark, str(tmp_path / "none"))
    with pytest.raises(NotADirectoryError):
        files.scan(spark, str(tmp_path / "c.csv"))
    with pytest.raises(ValueError):
        files.resolved({}, "base", "train", spark)


def test_corpus_of_files(spark, tmp_path):
    good = "Some sentence that is not of interest to anyone who might read it here. " * 4
    put(tmp_path, **{"first.txt": good, "second.txt": good.replace(" ", "  ", 1), "bad.pdf": b"%PDF"})
    rows = files.corpus_files(spark, str(tmp_path))
    staged = corpus.staged(rows, id_col="relative", raw=F.col("content"), text=F.col("text"), order=["relative"])
    assert {r["relative"]: r["stage"] for r in staged.collect()} == {"first.txt": "accepted", "second.txt": "content_duplicate", "bad.pdf": "failed"}
    n = sinks.write_cleaned(corpus.preprocess(files.text_files(spark, str(tmp_path)), F.col("text")), str(tmp_path / "cleaned"))
    assert n == {"processed": 2, "rejected": 0}
    sinks.write_corpus(staged, str(tmp_path / "out"), "relative")
    [train] = [p.read_text() for p in (tmp_path / "out/corpus").rglob("part-*.txt")]
    assert train == good.strip() + "\n\n"
    written = spark.read.json(str(tmp_path / "out/manifest")).first()
    assert written["source"] == "first.txt" and len(written["simhash"]) == 16


def test_a_tree_of_cleaned_texts(spark, tmp_path):
    good = "Some sentence that is not of interest to anyone who might read it here. " * 4
    put(tmp_path / "in", **{"a/b/one.txt": good + "  x\r\n", "a/two.MD": good, "a/short.txt": "no", "three é.text": "\uff41 " + good})
    rows = corpus.preprocess(files.text_files(spark, str(tmp_path / "in")), F.col("text"))
    for _ in range(2):  # again over what is there
        assert sinks.write_tree(rows, str(tmp_path / "out")) == {"processed": 3, "rejected": 1}
    tree = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()}
    assert tree == {"a/b/one.txt": good + "x", "a/two.MD": good.strip(), "three é.text": "a " + good.strip()}
    assert sinks.write_tree(rows.limit(0), str(tmp_path / "none")) == {"processed": 0, "rejected": 0}


def test_objects_of_any_shape():
    found = lambda o: [(*parts.values(), where) for parts, where in formats.parts_in(o)]
    assert found({"Question": "q", "answer": "a"}) == [("Answer the question accurately.", "q", "a", "question_answer", "")]
    assert found({"messages": [{"role": "user", "content": "u"}, {"from": "bot", "value": "b"}]})[0][1:3] == ("u", "b")
    late = [{"role": "bot", "text": "no"}, {"role": "human", "text": "u"}, {"role": "bot", "text": "b"}, {"role": "system", "text": "s"}, {"role": "user", "text": "v"}]
    assert found({"messages": late})[0][1:3] == ("u\n\nv", "b")
    assert found([{"role": "user", "content": "u"}, {"role": "assistant", "content": "b"}]) == []
    assert found({"conversations": [{"from": "human", "value": "u"}]}) == []
    deep = {"data": [{"x": {"instruction": "i", "output": "o", "type": "t"}}, [{"prompt": " p\n q ", "completion": 3}]]}
    assert found(deep) == [("i", "", "o", "t", "data[0].x"), ("Answer the question accurately.", "p q", "3", "question_answer", "data[1][0]")]


def test_a_file_of_lines_in_several_splits(spark, tmp_path):
    rows = [json.dumps({"question": f"q{i} " + "x" * 50, "answer": f"a{i}"}) for i in range(2_000)]
    rows[1_500] = "{bad"
    rows[700] = ""
    put(tmp_path, **{"deep/one.JSONL": "\r\n".join(rows), "two.jsonl": "\u2028" + rows[0], "t.csv": 'question,answer\n"q, of\ntwo lines",a\n\nr,b\n'})
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        assert spark.read.option("recursiveFileLookup", "true").text(str(tmp_path)).rdd.getNumPartitions() > 3
        out = formats.parsed_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    one = sorted((r["seq"], r["source_id"], r["input"], r["error"]) for r in out if r["file"] == "deep/one.JSONL" and r["error"] != "member")
    assert [(i, q.split()[0]) for _, i, q, e in one if not e] == [(str(n + 1), f"q{n}") for n in range(1_500) if n != 700]
    assert [e for *_, e in one if e] == ["parse_error:JSONDecodeError"]
    assert [r["source_id"] for r in out if r["file"] == "two.jsonl" and not r["error"]] == ["2"]
    assert sorted((r["source_id"], r["input"]) for r in out if r["file"] == "t.csv" and not r["error"]) == [("2", "q, oftwo lines"), ("3", "r")]


def test_ingest_of_every_format(spark, tmp_path):
    root = tmp_path / "in"
    qa = lambda n: {"question": f"q{n}", "answer": f"a{n}"}
    put(root, **{
        "a.json": json.dumps({"items": [qa(1), qa(2)]}),
        "b.jsonl": json.dumps(qa(3)) + "\n{bad\n" + json.dumps(qa(4)),
        "c.csv": "question,answer\nq5,a5\n",
        "d.tsv": "prompt\tcompletion\nq1\tA1\n",
        "e.xml": "<r xmlns='u'><p><question>q6</question><answer>a <b>6</b></answer></p></r>",
        "f.txt": "Is this a question?\nIt is, and this is its answer.\n",
        "g.xml": "<broken",
        "z.zip": b"no archive",
    })
    with zipfile.ZipFile(root / "ok.zip", "w") as z:
        z.writestr("in/h.json", json.dumps(qa(7)))
        z.writestr("skip.parquet", "x")
    pq.write_table(pa.table({"question": [f"row{i}" for i in range(10_002)], "answer": ["x"] * 10_002}), root / "p.parquet")
    parsed = formats.parsed_records(spark, str(root)).collect()
    ids = [r["source_id"] for r in parsed if r["source"] == "p.parquet" and r["error"] is None]
    assert ids[-3:] == ["9999", "0", "1"]
    (root / "p.parquet").unlink()
    model = tokens.train_bpe(spark.createDataFrame([("a b c Instruction Input Response",)], "t string"), F.col("t"), size=40, min_count=1, exact=False)
    counts = ingest.build(spark, str(root), str(tmp_path / "out"), model, context=200, shard_size=3)
    assert counts["accepted_records"] == 7 and counts["files_or_archive_members_seen"] == 8 and counts["unique_records_seen"] == 7
    assert list(counts) == """source_root tokenizer context_length files_or_archive_members_seen unique_records_seen accepted_records train_records validation_records test_records
        rejections length_distribution average_tokens unk_token_rate source_counts split_policy deduplication""".split()
    assert json.loads((tmp_path / "out/manifest.json").read_text()) == counts and sum(counts["source_counts"].values()) == 7
    assert sum(counts[f"{s}_records"] for s in ("train", "validation", "test")) == 7 and counts["length_distribution"] == {"within_context": 7}
    faults = {r["reason"]: r for r in spark.read.json(str(tmp_path / "out/rejections")).collect()}
    assert faults.keys() == {"parse_error:JSONDecodeError", "parse_error:ParseError", "file_error:BadZipFile"}
    assert faults["parse_error:JSONDecodeError"]["source"] == "b.jsonl" and "property name" in faults["parse_error:JSONDecodeError"]["error"]
    tight = ingest.build(spark, str(root), str(tmp_path / "tight"), model, context=2, tokenizer="t.json")
    assert (tight["accepted_records"], tight["unique_records_seen"], tight["rejections"]["over_context"], tight["tokenizer"]) == (0, 7, 7, "t.json")
    over = spark.read.json(str(tmp_path / "tight/rejections")).filter("reason = 'over_context'").collect()
    assert all(set(r["record"].asDict()) == {*records.V2_FIELDS, "id"} and set(r["stats"].asDict()) == set(ingest.STATS) for r in over)
    assert sum(r["stats"]["total_tokens"] for r in over) / 7 == tight["average_tokens"]
    assert counts["rejections"] == {"duplicate": 1, "parse_error:JSONDecodeError": 1, "parse_error:ParseError": 1, "file_error:BadZipFile": 1}
    written = spark.read.json(str(tmp_path / "out/records"))
    assert written.count() == 7 and {"prompt_tokens", "unk_tokens", "split", "shard"} <= set(written.columns)
    sources = {r["source"]: r["response"] for r in written.collect()}
    assert sources["e.xml"] == "a 6" and any(s.endswith("ok.zip::in/h.json") for s in sources)


def test_strict_jsonl(spark, tmp_path):
    row = {"instruction": "i", "input": "n", "response": "r", "category": "terminology"}
    path = tmp_path / "x.jsonl"
    load = lambda **o: jsonl.load(spark, str(path), categories=records.STRICT_CATEGORIES, **o)
    path.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"input": "m", "category": "summarization"}))
    assert [r["line_no"] for r in load().orderBy("line_no").collect()] == [1, 3]
    assert load(keep=("summarization",)).count() == 1
    for bad, word in ((row, "duplicate"), (row | {"input": " "}, "empty input"), (row | {"category": "no"}, "unsupported"), ({"input": "x"}, "missing")):
        path.write_text(json.dumps(row) + "\n" + json.dumps(bad))
        with pytest.raises(ValueError, match=f"line 2: {word}"):
            load()
    path.write_text("{not json")
    with pytest.raises(ValueError, match="line 1: not JSON"):
        load()


def test_instruction_builder(spark, tmp_path):
    root = tmp_path / "in"
    passage = "A passage that is long enough to be copied into the audit set, as it has more than one hundred and twenty characters in it."
    put(root, **{
        "a.txt": "What is the matter here?\nNothing is the matter, as far as anyone here can tell.\n\n" + passage,
        "MedQuAD/x/1.xml": "<d><QAPair><Question>Q one</Question><Answer>A <i>one</i></Answer></QAPair><QAPair><Question>Q</Question><Answer> </Answer></QAPair></d>",
        "MedQuAD/bad.xml": "<d>",
        instruction.CURATED: json.dumps({"instruction": "i", "input": "n", "response": "r", "category": "terminology"}),
    })
    supervised, audit = instruction.build_records(spark, str(root))
    assert sorted(r["category"] for r in supervised.collect()) == ["medquad_qa", "source_qa", "terminology"]
    assert audit.count() == 6
    counts = instruction.build(spark, str(root), str(tmp_path / "out"), least=3)
    assert [counts[s] for s in ("train", "validation", "test")] == [1, 1, 1] and counts["passage_copy_total"] == 3
    assert counts["supervised_total"] == 3 and counts["supervised_categories"] == {"medquad_qa": 1, "source_qa": 1, "terminology": 1}
    with pytest.raises(ValueError):
        instruction.build(spark, str(root), str(tmp_path / "out2"), least=100)


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    run = lambda: resumable.start(spark, src, out, state).awaitTermination()
    rows = lambda *r: spark.createDataFrame(r, resumable.SCHEMA).coalesce(1).write.mode("append").parquet(src)
    rows(("a", "b"), (None, None), (" ", "c"))
    run()
    run()
    assert sorted(r["text"] for r in spark.read.parquet(out).collect()) == ["a\n\nb\n\n", "c\n\n"]
    rows(("d", None))
    run()
    assert spark.read.parquet(out).count() == 3
