"""Whole documents as nested rows. A token is some thirty times as large in Spark's rows as in its text, so sentences are
packed, column by column and compressed, where their tokens were made; it is the packed form that moves, and only once.
What is counted of tokens by document is counted where they are unpacked."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schema import DETECTIONS, NOMINAL_ENDINGS, PASSIVE_DEPS, SECTION_WIRE
from . import compact

SENTENCE = ("para_idx", "sent_idx", "text", "tokens", *DETECTIONS)
METRICS = ("readability_grade", "lexical_density", "compression_ratio")
RATIOS = ("vocabulary_ttr", "nominalization_ratio", "passive_ratio")
#: Sentences of unpacked documents that are handed on at a time; a longer document is a batch of its own.
UNPACKED = 2000


def pack(sentences: DataFrame) -> DataFrame:
    """doc_id, packed: a document's neighbouring sentences, in one or more rows, as compact bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, body, blobs = batch.column(0), batch.select(list(SENTENCE)), []
            values = ids.to_pylist()
            starts = [i for i in range(len(values)) if i == 0 or values[i] != values[i - 1]]
            for i, end in zip(starts, [*starts[1:], len(values)], strict=True):
                blobs.append(compact.to_bytes(body.slice(i, end - i)))
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(starts, pa.int64())), pa.array(blobs, pa.binary())], names=["doc_id", "packed"])

    return sentences.select("doc_id", *SENTENCE).mapInArrow(run, f"doc_id {dict(sentences.dtypes)['doc_id']}, packed binary")


def unpack(blobs: list[bytes], schema: pa.Schema) -> list[pa.RecordBatch]:
    return [compact.from_bytes(b, schema) for b in blobs]


def ratios(batches: list[pa.RecordBatch]) -> tuple[float | None, float | None, float | None]:
    """RATIOS of a document's sentences, as in metrics.document_metrics, where counting them takes a shuffle of lemmas."""
    lemmas, n, nominal, passive = set(), 0, 0, 0
    for batch in batches:
        listed = batch.column("tokens")
        tokens = listed.flatten()
        of = dict(zip((f.name for f in tokens.type), tokens.flatten(), strict=True))
        own = of["lemma"].filter(pc.invert(pc.fill_null(of["is_punct"], False))).drop_null()
        lemmas.update(own.unique().to_pylist())
        n += len(own)
        nouns = of["text"].filter(pc.fill_null(pc.equal(of["pos"], "NOUN"), False)).drop_null().to_pylist()
        nominal += sum(x.lower().endswith(NOMINAL_ENDINGS) for x in nouns)
        hits = pc.is_in(of["dep"], value_set=pa.array(PASSIVE_DEPS, pa.string()))
        passive += len(pc.list_parent_indices(listed).filter(hits).unique())
    sentences = sum(map(len, batches))
    return len(lemmas) / n if n else None, nominal / n if n else None, passive / sentences if sentences else None


def lists(lengths: list[int | None], values: pa.Array) -> pa.ListArray:
    """Lists of the given lengths, in turn; null where the length is."""
    at, offsets = 0, []
    for n in lengths:
        offsets.append(None if n is None else at)
        at += n or 0
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def structs(names, arrays, type: pa.DataType) -> pa.Array:
    """Arrays as a struct of the type's fields, by name."""
    by_name = dict(zip(names, arrays, strict=True))
    return pa.StructArray.from_arrays([by_name[f.name] if by_name[f.name].type == f.type else by_name[f.name].cast(f.type) for f in type], fields=list(type))


def nested_sections(documents: list[dict], found: list[list[pa.RecordBatch]], sentence: pa.Schema, type: pa.DataType) -> pa.Array:
    """`sections` of documents given with their `paragraphs` and `heads`; found has the batches of each one's sentences."""
    section_type, paragraph_type = type.value_type, type.value_type.field("paragraphs").type.value_type
    order = [
        (i, p, s, sum(map(len, found[i][:k])) + n)
        for i in range(len(documents)) for k, b in enumerate(found[i]) for n, (p, s) in enumerate(zip(b.column("para_idx").to_pylist(), b.column("sent_idx").to_pylist(), strict=True))
    ]
    starts = [0]
    for batches in found:
        starts.append(starts[-1] + sum(map(len, batches)))
    all_sentences = pa.Table.from_batches([b for batches in found for b in batches], schema=sentence)
    per_section, per_paragraph, rows, heads, taken = [], [], [], [], []
    of: dict[tuple, list[int]] = {}
    for i, p, _, at in sorted(order):
        of.setdefault((i, p), []).append(starts[i] + at)
    for i, d in enumerate(documents):
        by_section: dict[int, list[dict]] = {}
        for p in sorted(d["paragraphs"] or [], key=lambda p: p["para_idx"]):
            by_section.setdefault(p["section_idx"], []).append(p)
        for head in sorted(d["heads"] or [], key=lambda h: h["section_idx"]):
            own = by_section.get(head["section_idx"])
            heads.append(head)
            per_section.append(own and len(own))
            for p in own or []:
                places = of.get((i, p["para_idx"]))
                rows.append(p)
                per_paragraph.append(places and len(places))
                taken += places or []
    if taken != list(range(all_sentences.num_rows)):
        all_sentences = all_sentences.take(pa.array(taken, pa.int64()))
    whole = all_sentences.combine_chunks()
    flat = [c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in whole.columns]
    sentence_type = paragraph_type.field("sentences").type.value_type
    sentences = lists(per_paragraph, structs(whole.column_names, flat, sentence_type))
    names = ("text", "in_blockquote", *METRICS)
    columns = [pa.array([p[c] for p in rows], paragraph_type.field(c).type) for c in names]
    paragraphs = lists(per_section, structs((*names, "sentences"), [*columns, sentences], paragraph_type))
    columns = [pa.array([h[c] for h in heads], section_type.field(c).type) for c in ("heading", "level")]
    return lists([d["heads"] and len(d["heads"]) for d in documents], structs(("heading", "level", "paragraphs"), [*columns, paragraphs], section_type))


def nest(documents: DataFrame, paragraphs: DataFrame, paragraph_rows: DataFrame, sentences: DataFrame) -> DataFrame:
    """documents, which have doc_id, with RATIOS and `sections`: null for a document without any; so are paragraphs and sentences."""
    documents = documents.drop(*RATIOS)
    listed = paragraph_rows.groupBy("doc_id").agg(F.collect_list(F.struct("section_idx", "para_idx", "text", "in_blockquote", *METRICS)).alias("paragraphs"))
    heads = paragraphs.groupBy("doc_id", "section_idx").agg(F.max("heading").alias("heading"), F.max("level").cast("int").alias("level"))
    heads = heads.groupBy("doc_id").agg(F.collect_list(F.struct("section_idx", "heading", "level")).alias("heads"))
    packed = pack(sentences).groupBy("doc_id").agg(F.collect_list("packed").alias("packed"))
    rows = documents.join(listed, "doc_id", "left").join(heads, "doc_id", "left").join(packed, "doc_id", "left")
    ddl = ", ".join(f"`{n}` {t}" for n, t in [*documents.dtypes, *((c, "double") for c in RATIOS)]) + f", sections ARRAY<{SECTION_WIRE}>"
    kept, schema = documents.columns, to_arrow_schema(StructType.fromDDL(ddl))
    sentence = to_arrow_schema(sentences.select(*SENTENCE).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            columns = [pa.array([d[c] for d in held], schema.field(c).type) for c in kept]
            columns += [pa.array(x, pa.float64()) for x in zip(*map(ratios, found), strict=True)]
            return pa.RecordBatch.from_arrays([*columns, nested_sections(held, found, sentence, schema.field("sections").type)], schema=schema)

        held, found, n = [], [], 0
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                own = unpack(row["packed"] or [], sentence)
                if held and n + sum(map(len, own)) > UNPACKED:
                    yield flush()
                    held, found, n = [], [], 0
                held.append(row)
                found.append(own)
                n += sum(map(len, own))
        if held:
            yield flush()

    return rows.mapInArrow(run, ddl)
