"""Parse providers: paragraphs to sentences with tokens. A provider is a function from DataFrame to DataFrame.

Input: doc_id, section_idx, para_idx, text, in_blockquote. Output: doc_id, section_idx, para_idx, sent_idx (running
through the document), text, tokens. Blockquotes aren't parsed, so they have no sentences.

A provider may have an attribute `failures`, a function from the same input to doc_id and message of documents that it
can't parse; the engine makes these error rows and leaves the documents out.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.tree import rebuilt_text
from ..schema import TOKENS
from . import models

Provider = Callable[[DataFrame], DataFrame]

# Fixed values of the rules provider. A sentence ends at end marks, however long it is; marks alone are one, too.
SENTENCE = r"[^.!?]*[.!?]+|[^.!?]+"
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]"
CLOSED = {
    "DET": ("the", "a", "an", "this", "these", "those"),
    "AUX": (
        "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "can", "could", "may", "might",
        "must", "shall", "should", "will", "would",
    ),
    "ADP": ("of", "in", "on", "at", "by", "for", "with", "from", "to", "as"),
    "CCONJ": ("and", "or", "but", "nor"),
    "PRON": ("i", "you", "he", "she", "it", "we", "they"),
    "ADV": ("not", "never"),
}
SUFFIXES = (("VERB", "(ed|ing|ize|ify)$"), ("ADV", "ly$"), ("ADJ", "(able|ous|ful|ive)$"))
LEMMAS = {"be": ("is", "are", "was", "were", "been", "being"), "have": ("has", "had"), "do": ("does", "did")}


def numbered(sentences: DataFrame) -> DataFrame:
    """Adds sent_idx, the place in the document's sentences, to rows with para_idx and n (place in the paragraph)."""
    return sentences.withColumn("sent_idx", F.row_number().over(W.partitionBy("doc_id").orderBy("para_idx", "n")) - 1)


def rules(paragraphs: DataFrame) -> DataFrame:
    """A deterministic baseline that fills the token table from closed word classes and endings; not a statistical parse.

    The root is the first verb, else auxiliary, else noun, else token. Determiners, prepositions and conjunctions attach
    to the next noun, auxiliaries to the next verb, adjectives to a noun right behind them, all else to the root. Tokens
    are made a batch of sentences at a time, in time linear in a sentence's length, and leave the rows where they are.
    """
    pieces = F.transform(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0)), lambda x: F.trim(x))
    sentences = paragraphs.where("NOT in_blockquote").select("doc_id", "section_idx", "para_idx", F.posexplode(pieces).alias("n", "text"))
    rows = numbered(sentences.where(F.col("text").rlike(r"\S")))
    # Not deterministic for the optimizer, or filters on tokens would have them made twice.
    tokens = F.arrow_udf(_rule_tokens, TOKENS).asNondeterministic()
    return rows.select("doc_id", "section_idx", "para_idx", "sent_idx", "text", tokens("text").alias("tokens"))


def _rule_tokens(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    parse = RuleParser()
    for texts in parts:
        yield parse(texts.to_pylist())


class RuleParser:
    """The rules on batches of sentences. What a word is, apart from its sentence, is looked up once."""

    MOST_WORDS = 200_000
    DEPS = ("root", "punct", "det", "case", "cc", "aux", "aux:pass", "advmod", "amod", "nsubj", "ccomp", "dep")
    FEATS = ("_", "Mood=Ind|Tense=Past|VerbForm=Fin", "Mood=Ind|VerbForm=Fin")

    def __init__(self) -> None:
        self.words: dict[str, tuple[str, str, int, bool]] = {}
        self.tag = {w: tag for tag, words in reversed(CLOSED.items()) for w in words}
        self.lemma = {w: base for base, words in LEMMAS.items() for w in words}
        self.endings = [(tag, regex.compile(ending)) for tag, ending in SUFFIXES]
        self.split = regex.compile(TOKEN)
        self.sign, self.number = regex.compile(r"[^\p{L}\p{N}]"), regex.compile(r"\p{N}+")

    def _word(self, form: str) -> tuple[str, str, int, bool]:
        """Tag, lemma, number of its features, and whether it ends in `ed`."""
        low = form.lower()
        if self.sign.match(form):
            tag = "PUNCT"
        elif self.number.fullmatch(form):
            tag = "NUM"
        else:
            tag = self.tag.get(low) or next((t for t, ending in self.endings if ending.search(low)), "NOUN")
        past = low.endswith("ed")
        feats = 1 if tag == "VERB" and past else 2 if low in ("is", "are", "was", "were") else 0
        if len(self.words) >= self.MOST_WORDS:
            self.words = {}
        found = self.words[form] = (tag, self.lemma.get(low, low), feats, past)
        return found

    def __call__(self, texts: list[str | None]) -> pa.Array:
        offsets, forms, lemmas, tags, feats, ids, heads, deps = [0], [], [], [], [], [], [], []
        deps_of = {name: i for i, name in enumerate(self.DEPS)}
        fixed = {"PUNCT": deps_of["punct"], "DET": deps_of["det"], "ADP": deps_of["case"], "CCONJ": deps_of["cc"], "ADV": deps_of["advmod"]}
        dep, amod, nsubj, ccomp, aux, passive, root_dep = (deps_of[x] for x in ("dep", "amod", "nsubj", "ccomp", "aux", "aux:pass", "root"))
        get = self.words.get
        for text in texts:
            own = self.split.findall(text or "")
            facts = [get(w) or self._word(w) for w in own]
            get = self.words.get  # the table may have been emptied
            kinds = [f[0] for f in facts]
            root = next((kinds.index(t) for t in ("VERB", "AUX", "NOUN") if t in kinds), 0)
            subject = next((i for i in range(root - 1, -1, -1) if kinds[i] in ("NOUN", "PRON")), -1)
            head_row, dep_row, noun, verb = [0] * len(own), [0] * len(own), -1, -1
            for i in range(len(own) - 1, -1, -1):  # backwards, with the next noun and verb at hand
                tag = kinds[i]
                head, link = root, fixed.get(tag)
                if link is None:
                    if tag == "AUX":
                        link = aux
                        if verb >= 0:
                            head, link = verb, passive if facts[i][1] == "be" and facts[verb][3] else aux
                    elif tag == "ADJ" and noun == i + 1:
                        head, link = noun, amod
                    else:
                        link = nsubj if i == subject else ccomp if tag == "VERB" else dep
                elif noun >= 0 and tag in ("DET", "ADP", "CCONJ"):
                    head = noun
                head_row[i], dep_row[i] = head + 1, link
                if tag == "NOUN":
                    noun = i
                elif tag == "VERB":
                    verb = i
            if own:
                head_row[root], dep_row[root] = 0, root_dep
            forms += own
            lemmas += [f[1] for f in facts]
            tags += kinds
            feats += [f[2] for f in facts]
            ids += range(1, len(own) + 1)
            heads += head_row
            deps += dep_row
            offsets.append(len(forms))
        same = pa.array(["_"]).take(pa.array([0] * len(forms), pa.int32()))
        columns = {
            "id": pa.array(ids, pa.int32()), "text": pa.array(forms, pa.string()), "lemma": pa.array(lemmas, pa.string()), "pos": pa.array(tags, pa.string()), "xpos": same,
            "feats": pa.array(self.FEATS).take(pa.array(feats, pa.int32())), "head": pa.array(heads, pa.int32()), "dep": pa.array(self.DEPS).take(pa.array(deps, pa.int32())),
            "deps": same, "misc": same, "is_punct": pa.array([t == "PUNCT" for t in tags], pa.bool_()),
        }
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))


def bad_lines(text: Column) -> Column:
    """Lines of a CoNLL-U text that aren't comments, empty, or ten fields with a proper id and no negative head."""
    lines = F.split(F.regexp_replace(text, "\r", ""), "\n")
    return F.filter(lines, lambda x: ~x.rlike("^[ \t]*$") & ~x.startswith("#") & ((F.size(F.split(x, "\t")) != 10) | ~x.rlike("^[0-9]+[-.0-9]*\t") | x.rlike("^([^\t]*\t){6}-")))


def conllu(parses: DataFrame) -> DataFrame:
    """Sentences from ten-column CoNLL-U: rows of doc_id, section_idx, para_idx, in_blockquote and `text` in that format.

    Comments, ranges (1-2) and empty nodes (1.1) are left out. A row with a bad line gives no sentence at all: see
    parse_failures, which the engine turns into error rows.
    """
    whole = parses.where("NOT in_blockquote").where(F.size(bad_lines(F.col("text"))) == 0)
    blocks = whole.select("doc_id", "section_idx", "para_idx", F.posexplode(F.split(F.regexp_replace("text", "\r", ""), "\n[ \t]*\n")).alias("n", "block"))
    words = F.filter(F.transform(F.split("block", "\n"), lambda x: F.split(x, "\t")), lambda f: f[0].rlike("^[0-9]+$") & (F.size(f) == 10))
    token = F.transform(
        words,
        lambda f: F.struct(
            f[0].cast("int").alias("id"), f[1].alias("text"), f[2].alias("lemma"), f[3].alias("pos"), f[4].alias("xpos"), f[5].alias("feats"),
            F.coalesce(f[6].try_cast("int"), F.lit(0)).alias("head"), f[7].alias("dep"), f[8].alias("deps"), f[9].alias("misc"), (f[3] == "PUNCT").alias("is_punct"),
        ),
    )
    sentences = numbered(blocks.withColumn("tokens", token.cast(TOKENS)).where("size(tokens) > 0"))
    return sentences.select("doc_id", "section_idx", "para_idx", "sent_idx", rebuilt_text().alias("text"), "tokens")


def parse_failures(parses: DataFrame) -> DataFrame:
    """doc_id and message, with the first bad line, of documents that aren't CoNLL-U."""
    bad = parses.where("NOT in_blockquote").select("doc_id", "para_idx", bad_lines(F.col("text")).alias("bad")).where("size(bad) > 0")
    return bad.groupBy("doc_id").agg(F.concat(F.lit("bad line: "), F.min_by(F.element_at("bad", 1), "para_idx")).alias("message"))


conllu.failures = parse_failures


def udpipe(model: str | bytes) -> Provider:
    """A statistical parser, if the ufal.udpipe package is there, from a model's path or its checked bytes (see models).

    One model a worker, from the bytes that the driver read. What a paragraph raises is that document's failure.
    """
    if isinstance(model, str):
        with open(model, "rb") as file:  # raises FileNotFoundError
            model = file.read()
    if importlib.util.find_spec("ufal") is None:
        raise models.ModelInvalid("invalid model: the ufal.udpipe package isn't installed")

    def make() -> Callable[[str], str]:
        from ufal.udpipe import Model, Pipeline

        pipeline = Pipeline(Model.loadFromMemory(model), "tokenize", Pipeline.DEFAULT, Pipeline.DEFAULT, "conllu")
        return pipeline.process

    return guarded(make)


#: Starts what a parser raised, in place of its CoNLL-U: no proper line, so it fails as one.
RAISED = "parser raised: "


def guarded(make: Callable[[], Callable[[str], str]]) -> Provider:
    """A provider from a function that makes, in each worker, a parser of texts to CoNLL-U.

    What the parser raises on a paragraph is kept in its row: such documents are failures, and others aren't touched.
    """

    def texts(paragraphs: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parse = make()

            def one(text: str) -> str:
                try:
                    return parse(text)
                except Exception as e:  # noqa: BLE001  whatever the parser raises
                    return RAISED + " ".join(f"{type(e).__name__}: {e}".split())

            for batch in batches:
                columns = {name: batch[name] for name in batch.schema.names}
                columns["text"] = pa.array([one(t) for t in batch["text"].to_pylist()], pa.string())
                yield pa.RecordBatch.from_pydict(columns, schema=batch.schema)

        rows = paragraphs.where("NOT in_blockquote").select("doc_id", "section_idx", "para_idx", "in_blockquote", "text")
        return rows.mapInArrow(run, rows.schema)

    def parse(paragraphs: DataFrame) -> DataFrame:
        return conllu(texts(paragraphs))

    parse.failures = lambda paragraphs: parse_failures(texts(paragraphs))
    return parse
