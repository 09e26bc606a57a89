"""Functions, detections, gates and laws on small cases of their own."""

import hashlib
import json
import os
import re

import pytest
from pyspark.sql import functions as F

from prosestruct import cli
from prosestruct.functions import text, tree
from prosestruct.operators import decompose, extract, metrics
from prosestruct.operators.detect import detect
from prosestruct.plans.engine import Engine
from prosestruct.plans.queries import trees
from prosestruct.schema import CYCLE, MAX_INPUT_BYTES, RAW, STOP_WORDS
from prosestruct.sources import ingest, models, providers


def raw(spark, *texts, format="plain"):
    return spark.createDataFrame([(i, None, t, format) for i, t in enumerate(texts)], RAW)


def test_stop_words_are_sorted_and_distinct():
    assert list(STOP_WORDS) == sorted(set(STOP_WORDS)) and len(STOP_WORDS) == 105


def test_syllables(spark):
    words = {"the": 1, "": 0, "cake": 1, "banana": 3, "rhythm": 1, "été": 1, "queue": 1, "idea": 2, "12": 0, "e": 1, "agree": 1}
    rows = spark.createDataFrame(list(words.items()), "w string, n int").select("w", "n", text.syllables(F.col("w")).alias("got")).collect()
    assert {r.w: r.got for r in rows} == words


def test_formulas_without_words(spark):
    row = spark.createDataFrame([("",), ("    ",)], "t string").select(text.readability(F.col("t")), text.lexical_density(F.col("t"))).collect()
    assert [tuple(r) for r in row] == [(0.0, None), (0.0, None)]


def test_tree_functions(spark):
    depths = {r.sent: r.d for r in trees(spark).select("sent", tree.tree_depth().alias("d")).collect()}
    assert depths["cycle"] == depths["self_loop"] == CYCLE
    assert depths["dangling"] == 2 and depths["chain"] == 29 and depths["passive"] == 2
    none = spark.sql("SELECT filter(array(named_struct('id', 1, 'head', 0)), x -> false) AS tokens").select(tree.tree_depth().alias("d")).first()
    assert none.d == 0


def test_detections(spark):
    rows = {r.sent: r for r in detect(trees(spark)).collect()}
    assert [p.pattern for p in rows["such_as"].hearst_pairs] == ["such_as"] * 3
    assert [p.hyponym.head_lemma for p in rows["and_other"].hearst_pairs] == ["ant", "bee"]
    assert rows["and_other"].hearst_pairs[0].hypernym.asDict() == {"head_id": 7, "head_lemma": "insect", "first_id": 6, "last_id": 7}
    assert rows["the_other"].hearst_pairs == rows["plain_nmod"].hearst_pairs == []
    assert (rows["flat_name"].hearst_pairs[0].hyponym.first_id, rows["flat_name"].hearst_pairs[0].hyponym.last_id) == (4, 6)
    assert rows["copula"].bare_assertion and not rows["modal_copula"].bare_assertion and not rows["rootless"].bare_assertion
    assert rows["reporting"].reportings[0].subject_lemma == "critic" and rows["reporting_no_subject"].reportings[0].subject_lemma is None
    assert [n.cue_lemma for n in rows["neither"].negations] == ["neither", "nor"]
    assert rows["rootless"].root_adverbials == []


def test_rebuilt_text(spark):
    row = trees(spark).where("sent = 'reporting'").select(tree.rebuilt_text().alias("t")).first()
    assert row.t == "Critics say that prices reportedly were fixed."


def test_plain_paragraphs(spark):
    rows = decompose.plain(raw(spark, " a \n\n\n\nb\n \nc", "", "\r\n\r\nx")).collect()
    assert [(r.doc_id, r.para_idx, r.text) for r in rows] == [(0, 0, "a"), (0, 1, "b\n \nc"), (2, 0, "x")]


def test_markdown(spark):
    source = "---\ntitle: x\n---\nintro\n\n# One\n> quoted\nrest\n```\ncode\n```\nmore\n| a | b |\n\n#tag\n## References\nlost"
    rows = decompose.markdown(raw(spark, source, "---\nnever closed", format="markdown")).orderBy("doc_id", "section_idx", "para_idx").collect()
    got = [(r.section_idx, r.para_idx, r.heading, r.level, r.text, r.in_blockquote) for r in rows]
    assert got == [(0, 0, None, 0, "intro", False), (1, 1, "One", 1, "quoted\nrest\nmore", True), (2, None, "tag", 1, None, None)]


def test_gates_and_partition(spark):
    rows = spark.createDataFrame([(1, "a.pdf", "x", "pdf"), (2, None, "y" * 8_388_609, "pdf"), (3, None, "z" * 8_388_608, "plain"), (4, None, None, "plain")], RAW)
    good, errors = ingest.split_errors(ingest.gate(rows))
    assert sorted(r.doc_id for r in good.collect()) == [3, 4]
    shown = {r.doc_id: (r.error.kind, r.m) for r in errors.withColumn("m", ingest.display(F.col("path"), F.col("error"))).collect()}
    assert shown == {1: ("UnsupportedFormat", "a.pdf: unsupported format: Pdf"), 2: ("InputTooLarge", "input input too large: 8388609 > limit 8388608")}
    with pytest.raises(ValueError):
        Engine().analyze_one(spark, "x", "docx")


def test_laws_of_analysis(spark):
    engine = Engine(suite=())
    a, b = raw(spark, "One thing ended. It was good."), raw(spark, "", "Two.").withColumn("doc_id", F.col("doc_id") + 10)
    whole = {r.doc_id: r.asDict(recursive=True) for r in engine.analyze(a.unionByName(b))[0].collect()}
    parts = {r.doc_id: r.asDict(recursive=True) for part in (a, b) for r in engine.analyze(part)[0].collect()}
    assert whole == parts and set(whole) == {0, 10, 11}
    assert engine.analyze(a.limit(0))[0].count() == 0
    assert whole[10]["passive_ratio"] is None and whole[10]["sections"] is None


def test_json_round_trip(spark):
    documents, _ = Engine(suite=()).analyze(raw(spark, "The red box was opened. It may fall."))
    back = ingest.from_json(ingest.to_json(documents.drop("path"))).first().asDict(recursive=True)
    assert back["sections"][0]["paragraphs"][0]["sentences"][0]["negations"] == []
    assert back["sections"][0]["paragraphs"][0]["sentences"][1]["modals"][0]["aux_lemma"] == "may"
    old = spark.createDataFrame([(1, json.dumps({"sections": [{"level": 0, "paragraphs": [{"text": "a", "in_blockquote": False, "sentences": [{"text": "a", "tokens": []}]}]}]}))], "doc_id long, json string")
    sentence = ingest.from_json(old).first().sections[0].paragraphs[0].sentences[0]
    assert sentence.bare_assertion is False and sentence.hearst_pairs == []


def test_blockquotes_are_not_parsed(spark):
    a = Engine().annotate(raw(spark, "> He said it works.\n\nPlain words stand here.", format="markdown"))
    assert [r.para_idx for r in a.sentences.collect()] == [1]
    rows = {r.para_idx: r for r in metrics.paragraph_metrics(a.paragraphs, a.sentences).collect()}
    assert rows[0].lexical_density is None and rows[1].lexical_density is not None


def test_compression_gate(spark):
    rows = metrics.compression_metric(spark.createDataFrame([(51, False, "word " * 51), (50, False, "word " * 50), (60, True, "word " * 60)], "word_count long, in_blockquote boolean, text string"))
    got = [r.compression_ratio for r in rows.collect()]
    assert 0 < got[0] < 0.5 and got[1] is None and got[2] is None


def test_extractor_limits_and_empty(spark):
    engine = Engine()
    rows = raw(spark, "a b. " * 5)
    assert engine.extract_errors(rows, "tfidf", 4).first().error.message == "tfidf input too large: 5 > limit 4"
    assert engine.summarize(rows, "tfidf", 0).count() == 0
    assert extract.textrank_scores(engine.parse(raw(spark, "Alone here."))[1]).first().score == pytest.approx(1 - 0.85)


def test_conllu(spark):
    block = "# text\n1\tShe\tshe\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\tran\trun\tVERB\t_\tMood=Ind\t0\troot\t_\tSpaceAfter=No\n3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n\n1\tYes\tyes\tINTJ\t_\t_\t0\troot\t_\t_\n"
    rows = spark.createDataFrame([(1, 0, 0, block, False)], "doc_id long, section_idx int, para_idx int, text string, in_blockquote boolean")
    assert [(r.sent_idx, r.text) for r in providers.conllu(rows).orderBy("sent_idx").collect()] == [(0, "She ran."), (1, "Yes")]
    assert providers.parse_failures(rows).count() == 0
    assert providers.parse_failures(rows.withColumn("text", F.lit("1\tonly three\tfields"))).count() == 1


def test_folder_source(spark, tmp_path):
    (tmp_path / "b.md").write_text("# H\n\nBody text.")
    (tmp_path / "a.txt").write_text("Plain.")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    documents, errors = ingest.path_source(spark, str(tmp_path))
    assert [(r.path.rsplit("/", 1)[1], r.format) for r in documents.orderBy("path").collect()] == [("a.txt", "plain"), ("b.md", "markdown")]
    assert [r.error.kind for r in errors.collect()] == ["Io"]
    with pytest.raises(FileNotFoundError):
        ingest.path_source(spark, str(tmp_path / "missing"))


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "x.md"
    path.write_text("# Title\n\nRivers flooded the town. The town was closed.")
    run = lambda *a: cli.run(cli.parser().parse_args([str(x) for x in a]), spark)
    assert run("summarize", path, "-n", 1, "--json") == 0 and "Title" not in capsys.readouterr().out
    assert run("keyphrases", path, "--method", "yake") == 0
    assert run("analyze", path, "-s") == 0 and "# Title: 1 paragraphs, 2 sentences, 8 words" in capsys.readouterr().out
    (tmp_path / "empty.txt").write_text("")
    assert run("summarize", tmp_path / "empty.txt") == 1
    assert cli.main(["analyze", str(tmp_path / "none")]) == 2


def test_stream_matches_batch(spark, tmp_path):
    rows = raw(spark, "One.\n\nTwo three.", "Four.")
    rows.write.parquet(str(tmp_path / "in"))
    from prosestruct.streaming.stream import analyze_stream, paragraph_stream

    stream = spark.readStream.schema(RAW).parquet(str(tmp_path / "in"))
    query = paragraph_stream(stream)[0].writeStream.format("memory").queryName("paras").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.text for r in spark.table("paras").collect()) == ["Four.", "One.", "Two three."]
    seen = []
    analyze_stream(stream, Engine(suite=()), lambda d, e, n: seen.extend(r.doc_id for r in d.collect())).trigger(availableNow=True).start().awaitTermination()
    assert sorted(seen) == [0, 1]


def test_long_sentences_are_not_cut(spark):
    words = [f"word{i}x" for i in range(2000)]
    texts = ["They claimed " + " ".join(words), "no marks here " * 40 + "may end. Next one?! Last", "y" * 1300]
    raw = spark.createDataFrame([(i, None, t, "plain") for i, t in enumerate(texts)], "doc_id long, path string, text string, format string")
    rows = Engine().parse(raw)[1].orderBy("doc_id", "sent_idx").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(i, s.strip()) for i, t in enumerate(texts) for s in re.findall(providers.SENTENCE, t)]
    assert [t.text for t in rows[0].tokens] == ["They", "claimed", *words] and [t.head for t in rows[0].tokens].count(0) == 1
    assert [t.text for t in rows[-1].tokens] == ["y" * 1300]


def test_end_marks_are_kept(spark):
    rows = Engine().parse(raw(spark, "...Hello there. ?!", "!!!", " . "))[1].orderBy("doc_id", "sent_idx").collect()
    assert [(r.doc_id, r.text, [t.text for t in r.tokens]) for r in rows] == [
        (0, "...", ["."] * 3), (0, "Hello there.", ["Hello", "there", "."]), (0, "?!", ["?", "!"]), (1, "!!!", ["!"] * 3), (2, ".", ["."]),
    ]
    assert [t.head for t in rows[3].tokens] == [0, 1, 1]


def test_carriage_returns(spark):
    rows = decompose.markdown(raw(spark, "one\r\ntwo\r\r\nthree\r", format="markdown")).collect()
    assert [r.text for r in rows] == ["one\ntwo\r\nthree"]


BLOCK = "1\tShe\tshe\tPRON\t_\t_\t2\tnsubj\t_\t_\n2\tran\trun\tVERB\t_\t_\t0\troot\t_\t_"


def test_parse_failures_are_error_rows(spark):
    """One bad line fails its document, with its message, and leaves the others alone."""
    engine = Engine(provider=providers.conllu)
    rows = raw(spark, BLOCK, BLOCK + "\n3\tbroken", BLOCK.replace("\t2\tnsubj", "\t-1\tnsubj"), "")
    documents, errors = engine.analyze(rows)
    assert sorted(r.doc_id for r in documents.collect()) == [0, 3]
    shown = {r.doc_id: (r.error.kind, r.error.message) for r in errors.collect()}
    assert set(shown) == {1, 2} and shown[1] == ("ParseFailed", "parse failed: bad line: 3\tbroken") and shown[2][1].startswith("parse failed: bad line: 1\tShe")
    assert providers.conllu(engine.parse(rows.where("doc_id = 1"))[0]).count() == 0
    with pytest.raises(RuntimeError):
        engine.extract_one(spark, "1\tbroken")


def test_what_a_parser_raises_is_its_documents_failure(spark):
    def make():
        def parse(text):
            if "boom" in text:
                raise ValueError("no parse\nhere")
            return "\n".join(f"{i}\t{w}\t{w}\tNOUN\t_\t_\t0\troot\t_\t_" for i, w in enumerate(text.split(), 1))

        return parse

    documents, errors = Engine(provider=providers.guarded(make), suite=()).analyze(raw(spark, "a b", "fine\n\nboom", "c"))
    assert sorted(r.doc_id for r in documents.collect()) == [0, 2]
    assert [(r.doc_id, r.error.message) for r in errors.collect()] == [(1, "parse failed: bad line: parser raised: ValueError: no parse here")]


def test_extract_returns_results_and_errors(spark, monkeypatch):
    monkeypatch.setitem(extract.LIMITS, "tfidf", 4)
    rows = raw(spark, "a b. " * 5, "Two words. More here.").unionByName(raw(spark, "x", format="pdf").withColumn("doc_id", F.lit(9).cast("long")))
    found, errors = Engine().extract(rows, "tfidf", 1)
    assert {r.doc_id for r in found.collect()} == {1}
    assert {r.doc_id: r.error.message for r in errors.collect()} == {0: "tfidf input too large: 5 > limit 4", 9: "unsupported format: Pdf"}
    assert Engine().extract(rows.where("doc_id = 0"), "tfidf", 0)[1].count() == 0
    with pytest.raises(ValueError):
        Engine().extract_one(spark, "a b. " * 5)
    # Always plain: a heading is prose here.
    assert [r["text"] for r in Engine().extract_one(spark, "# Rivers rose. Towns flooded.", "textrank", 2)] == ["# Rivers rose.", "Towns flooded."]


def test_command_line_errors(spark, tmp_path, capsys, monkeypatch):
    run = lambda *a: cli.run(cli.parser().parse_args([str(x) for x in a]), spark)
    (tmp_path / "a.pdf").write_text("text")
    (tmp_path / "b.txt").write_text("One. " * 6)
    monkeypatch.setitem(extract.LIMITS, "textrank", 5)
    for arguments in (("summarize", tmp_path / "a.pdf"), ("keyphrases", tmp_path / "a.pdf"), ("summarize", tmp_path / "b.txt", "--method", "textrank")):
        with pytest.raises(ValueError):
            run(*arguments)
    (tmp_path / "big.txt").write_bytes(b"x" * (MAX_INPUT_BYTES + 1))
    with pytest.raises(ValueError):
        run("analyze", tmp_path / "big.txt")
    assert run("analyze", tmp_path / "b.txt") == 0
    shown = capsys.readouterr().out
    assert "sentences: 6" in shown and "words: 6" in shown and "mean_sentence_length: 1.0" in shown and "passive_ratio: 0.000" in shown
    with pytest.raises(FileNotFoundError):
        run("--model-dir", tmp_path / "none", "analyze", tmp_path / "b.txt")


def test_files_and_listing(spark, tmp_path):
    for name in ("b.txt", "a.md", ".md", "C.MD"):
        (tmp_path / name).write_text("x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "l.txt").symlink_to(tmp_path / "b.txt")
    os.mkfifo(tmp_path / "pipe")
    assert [os.path.basename(p) for p in ingest.candidate_paths(str(tmp_path))] == [".md", "C.MD", "a.md", "b.txt"]
    assert ingest.accepts(str(tmp_path / "b.txt")) and not ingest.accepts(str(tmp_path / "sub")) and not ingest.accepts(str(tmp_path / "pipe"))
    rows = spark.createDataFrame([(n,) for n in (".md", "x/.md", "a.md", "..md", "C.MD", "a.", "d.md/e")], "p string").select("p", ingest.detect_format(F.col("p")).alias("f")).collect()
    assert {r.p: r.f for r in rows} == {".md": "plain", "x/.md": "plain", "a.md": "markdown", "..md": "markdown", "C.MD": "plain", "a.": "plain", "d.md/e": "plain"}
    for name in ("l.txt", "pipe"):
        with pytest.raises(OSError):
            ingest.path_source(spark, str(tmp_path / name))


def test_models_are_checked(tmp_path):
    data = b"model bytes"
    model = models.Model("m.bin", len(data), hashlib.sha256(data).hexdigest())
    folder, calls = str(tmp_path / "models"), []

    def fetch(path, content=data):
        calls.append(path)
        with open(path, "wb") as file:
            file.write(content)

    with pytest.raises(FileNotFoundError):
        models.load(folder, model)
    assert models.load(folder, model, fetch) == data and models.load(folder, model) == data and len(calls) == 1
    with open(os.path.join(folder, "m.bin"), "wb") as file:
        file.write(b"model bytez")
    with pytest.raises(models.ModelInvalid):
        models.load(folder, model)
    assert models.load(folder, model, fetch) == data and len(calls) == 2 and os.listdir(folder) == ["m.bin"]
    os.remove(os.path.join(folder, "m.bin"))
    with pytest.raises(models.ModelInvalid):
        models.load(folder, model, lambda path: fetch(path, b"wrong"))


def test_passive_share_is_zero_without_sentences(spark):
    rows = raw(spark, "", "The box was opened. It fell.")
    a = Engine().annotate(rows)
    found = {r.doc_id: (r.passive_ratio, r.passive_share) for r in metrics.document_metrics(a.raw, a.paragraphs, a.sentences).collect()}
    assert found == {0: (None, 0.0), 1: (0.5, 0.5)}


def test_sentences_move_packed(spark):
    """Tokens don't pass through a shuffle of Spark's own rows, and documents nest from packed sentences in any order."""
    from prosestruct.operators import nest

    raw = spark.createDataFrame([(1, None, "# A\n\n# B\n\n> quote\n\nText here. More!", "markdown"), (2, None, "One. Two.\n\nThree.", "plain"), (3, None, "", "plain")], "doc_id long, path string, text string, format string")
    engine = Engine()
    nested = engine.analyze(raw)[0]
    plan = nested._jdf.queryExecution().executedPlan().toString()
    assert not any("tokens" in line for line in plan.split("\n") if "ObjectHashAggregate" in line and "collect_list" in line)
    got = {r.doc_id: r.sections for r in nested.collect()}
    assert [s.heading for s in got[1]] == ["A", "B"] and got[1][0].paragraphs is None and got[1][1].paragraphs[0].sentences is None and got[3] is None
    assert [[s.text for s in p.sentences] for p in got[2][0].paragraphs] == [["One.", "Two."], ["Three."]]
    a = engine.annotate(raw)
    upset = nest.nest(nested.drop("sections"), a.paragraphs, metrics.paragraph_metrics(a.paragraphs, a.sentences), a.sentences.repartition(3, "text"))
    assert {r.doc_id: r.sections for r in upset.collect()} == got


def test_nested_documents_move_compact(spark):
    """Sentences move as few bytes, whatever they hold, and ratios are counted behind them: no lemma is shuffled."""
    import pyarrow as pa

    from prosestruct.operators import compact, metrics

    token = pa.list_(pa.struct([("a", pa.int32()), ("s", pa.string()), ("b", pa.bool_()), ("l", pa.list_(pa.int32()))]))
    values = [None, [], [{"a": 1, "s": "x", "b": None, "l": [1, None]}, None, {"a": None, "s": None, "b": True, "l": None}]]
    values.append([{"a": -(2**31), "s": "", "b": False, "l": []}, {"a": 2**31 - 1, "s": "日本", "b": True, "l": [5]}])
    batch = pa.record_batch({"x": pa.array(values * 3, token), "n": pa.array([1.5, None, 2.0] * 4), "s": pa.array([None] * 12, pa.string())})
    for part in (batch, batch.slice(3, 5), batch.slice(0, 0), batch.slice(11, 1)):
        read = compact.from_bytes(compact.to_bytes(part), part.schema)
        read.validate(full=True)
        assert read.to_pylist() == part.to_pylist()
    # Columns that go by the first one, and one that doesn't; with a null, a column goes by nothing.
    for last in ("y", "z", None):
        rows = [[{"i": 1, "k": "A", "v": "a", "w": "x"}, {"i": 2, "k": "B", "v": "a", "w": "y"}], [{"i": 3, "k": "A", "v": "a", "w": last}]]
        part = pa.record_batch({"t": pa.array(rows, pa.list_(pa.struct([("i", pa.int32()), *((c, pa.string()) for c in "kvw")])))})
        assert compact.from_bytes(compact.to_bytes(part), part.schema).to_pylist() == part.to_pylist()
    texts = ["The nation was opened. It may fail. THE ACTIVITY, İTY; ity!", "", "...", "Boxes. Boxes were seen by a city.\n\n> quoted nation"]
    rows = spark.createDataFrame([(i, None, t, "markdown") for i, t in enumerate(texts)], "doc_id BIGINT, path STRING, text STRING, format STRING")
    engine = Engine(suite=())
    nested, a = engine.analyze(rows)[0], engine.annotate(rows)
    ratios = ("doc_id", "vocabulary_ttr", "nominalization_ratio", "passive_ratio")
    want = metrics.document_metrics(a.raw, a.paragraphs, a.sentences).select(*ratios).collect()
    assert sorted(map(tuple, nested.select(*ratios).collect())) == sorted(map(tuple, want))
    assert "lemma" not in "".join(x for x in nested._jdf.queryExecution().executedPlan().toString().split("\n") if "Aggregate" in x or "Exchange" in x)
